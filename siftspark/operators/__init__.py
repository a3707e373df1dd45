"""Composable steps over catalogue, content and chunk DataFrames."""
