"""Readers and writers: listing files, loose chunks, local trees and HTTP stores."""
