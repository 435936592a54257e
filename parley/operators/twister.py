"""Any place of a seeded Mersenne Twister's stream, without the words before it.

The generator is linear over two elements, so its state after k words is the
polynomial x^k, reduced by the generator's characteristic polynomial, applied to
the first state.  The characteristic polynomial is found from the stream itself;
polynomials are Python integers, a bit for each coefficient.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

#: Words of a state, and the degree of the characteristic polynomial.
STATE = 624
DEGREE = 19_937


def _generator(state: np.ndarray) -> np.random.RandomState:
    made = np.random.RandomState()
    made.set_state(("MT19937", state, STATE))
    return made


def first_state(seed: int) -> np.ndarray:
    """The state that ``random.Random(seed)`` starts from."""
    return np.array(random.Random(seed).getstate()[1][:STATE], np.uint32)


def _untempered(state: np.ndarray, n: int) -> np.ndarray:
    """At least ``n`` words of the recurrence, the state's own first."""
    made, parts = _generator(state), [state]
    while sum(map(len, parts)) < n:
        made.bytes(4 * STATE)
        parts.append(made.get_state()[1])
    return np.concatenate(parts)


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The shortest recurrence of one bit of the stream (Berlekamp and Massey), which is that of the state."""
    bits = (_untempered(first_state(1), 2 * DEGREE + 2) >> 31).tolist()
    mask = (1 << DEGREE + 1) - 1
    now, old, length, gap, seen = 1, 1, 0, 1, 0
    for i, bit in enumerate(bits[: 2 * DEGREE + 2]):
        seen = (seen << 1 | bit) & mask
        if (now & seen).bit_count() & 1:
            kept = now
            now ^= old << gap
            if 2 * length <= i:
                length, old, gap = i + 1 - length, kept, 0
        gap += 1
    return int(f"{now:0{length + 1}b}"[::-1], 2)


def power(k: int, modulus: int) -> int:
    """x^k modulo the characteristic polynomial: squarings of a polynomial only spread its bits."""
    terms = [i for i, c in enumerate(reversed(f"{modulus:b}")) if c == "1"][:-1]
    low = (1 << DEGREE) - 1
    found = 1
    for bit in f"{k:b}":
        found = int("0".join(f"{found:b}"), 2) << int(bit)
        while high := found >> DEGREE:
            found &= low
            for t in terms:
                found ^= high << t
    return found


def state_at(seed: int, k: int, modulus: int) -> np.ndarray:
    """The state before word ``k`` of the stream."""
    first = first_state(seed)
    if not k:
        return first
    run = _untempered(first, DEGREE + STATE)
    state = np.zeros(STATE, np.uint32)
    for i, c in enumerate(reversed(f"{power(k, modulus):b}")):
        if c == "1":
            state ^= run[i : i + STATE]
    return state


def generator(seed: int, start: int, modulus: int) -> np.random.RandomState:
    """A generator that goes on with word ``start`` of ``random.Random(seed)``."""
    return _generator(state_at(seed, start, modulus))


def words(seed: int, start: int, n: int, modulus: int) -> np.ndarray:
    """Words ``start`` to ``start + n`` of ``random.Random(seed)``."""
    return np.frombuffer(generator(seed, start, modulus).bytes(4 * n), "<u4")
