"""Column functions and the chunked ranking shared by the operators."""
