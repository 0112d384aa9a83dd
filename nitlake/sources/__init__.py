"""Tables, manifests, folders and pictures as DataFrames."""
