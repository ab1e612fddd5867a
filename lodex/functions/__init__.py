"""Column expressions that the jobs are made of; all are native, none is a Python function."""
