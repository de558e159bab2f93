"""Sequential text scanners: plain Python, wrapped as Arrow functions where they meet DataFrames."""
