"""Live requests: what to keep of a stream of them, and how to run only the newest."""
