"""Column expressions over SMILES strings, formulas and reaction sides. No Python UDFs."""
