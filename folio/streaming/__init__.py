"""The stateless transforms over streams of files."""
