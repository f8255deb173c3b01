"""Jobs to run with spark-submit: each a function that takes a session, and a command line."""
