import random

import pytest

WORDS = "the of and to in is it that was for on are as with his they at be this from have or by one had not but what all were when".split()


@pytest.fixture(scope="session")
def prose():
    """A function giving invented sentences."""
    def make(rng: random.Random, n_words: int) -> str:
        return " ".join(rng.choice(WORDS) + rng.choice("aeioulnrst") * rng.randint(0, 2) + str(rng.randint(0, 40)) for _ in range(n_words))
    return make
