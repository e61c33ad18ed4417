"""Training-data operators: cleaning, de-duplication, filtering, mixing and tokenised output."""
