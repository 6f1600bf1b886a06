"""RML documents: a Turtle reader and the translation to plans."""
