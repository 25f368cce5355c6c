"""Training-data operators.  Nothing outside this folder imports it; it can be deleted as a whole."""
