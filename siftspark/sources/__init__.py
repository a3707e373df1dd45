"""Where files, their bodies and logs come from and go to."""
