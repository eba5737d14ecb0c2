"""Training-data operators: ten stages that prepare a corpus for a language model."""
