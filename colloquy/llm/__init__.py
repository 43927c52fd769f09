"""Training-data operators: text cleaning, identification, packing and mixing of meeting material."""
