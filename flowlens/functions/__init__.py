"""Column expressions shared by the operators. All stay inside Catalyst; none is a Python UDF."""
