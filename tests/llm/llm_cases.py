"""Shared inputs of these tests."""

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "A b"), (5, "é" * 50), (6, "x " * 30_000), (None, "no id"), (7, "same text here"), (7, "same text here")]
