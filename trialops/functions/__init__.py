"""Column builders: null rules, labels of looks, trial sequences, coded screens."""
