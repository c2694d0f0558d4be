"""chronoforest: tree-dating relations, validators and reports as Spark DataFrames."""
