"""Studies: compositions of the operators that answer one research question each."""
