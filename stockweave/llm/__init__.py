"""Operations for large-scale training data, each in its own module."""
