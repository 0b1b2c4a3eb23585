"""Texts for the tests of this folder."""

WORDS = [f"w{i}" for i in range(4000)]


def prose(seed: int, n: int) -> str:
    """Words without order, a full stop after every ninth."""
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * (seed + 13)) % 4000] + ("." if i % 9 == 8 else "") for i in range(n))
