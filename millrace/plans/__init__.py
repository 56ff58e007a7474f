"""The registered queries: each operator at work on the shared tables, with its SQL check."""
