"""Texts made for tests."""

import random

WORDS = "the of and to in is that it was for on are as with his they at be this from or had by hot word but what some we can out".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", r.choice(WORDS)]) for _ in range(n))
