"""Column functions: parsing of answers, intervals, sequences, hash choices."""
