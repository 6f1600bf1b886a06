"""Plan documents: model, validation, rewrites and lowering to DataFrames."""
