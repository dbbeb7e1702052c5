"""Part of graphfold."""
