"""Helpers of these tests."""

import random

WORDS = "the of and in ther tion ing hat re ou er st en nd sh ea wh ble ly es or an it is on".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(words))
