"""Jobs over the listing table and its companions; each is a function of DataFrames."""
