"""ShExML documents: the part of the language that row-wise sources need."""
