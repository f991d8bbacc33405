"""Jobs around user-supplied model functions: batches in, values out, resumable."""
