"""Training-data operators: filters, classifiers, scans and near-duplicate jobs over text tables."""
