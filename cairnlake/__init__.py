"""cairnlake: content-addressed data operations written as PySpark DataFrame plans."""
