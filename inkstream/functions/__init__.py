"""Column helpers and building blocks shared by the operators."""
