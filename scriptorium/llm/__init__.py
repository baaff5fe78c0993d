"""Training-data operators: packing, classification, search and de-duplication."""
