"""Pattern expressions, their transducers and the choice of a way to run them."""
