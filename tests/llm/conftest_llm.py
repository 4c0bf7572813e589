"""Made-up texts for the tests of this folder."""

import random


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))
