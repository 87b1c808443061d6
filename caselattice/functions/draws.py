"""The numbers of `scalar.draw` for many draws at once, in numpy: the first eight hex digits of the MD5 of a text that ends in a
draw's number. Made inside a function, it travels to the executors by value."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache


@cache
def drawer() -> Callable:
    """draws(prefixes, start, stop): for each prefix the numbers that `prefix + str(d)` gives for d from start to stop - 1."""
    import math

    import numpy as np

    sines = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]

    def compress(state: list, words: list) -> list:
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            x, s = a + f + sines[i] + words[g], turns[i // 16][i % 4]
            a, d, c, b = d, c, b, b + ((x << np.uint32(s)) | (x >> np.uint32(32 - s)))
        return [s + t for s, t in zip(state, (a, b, c, d), strict=True)]

    def of_length(prefixes: list[bytes], numbers: np.ndarray, digits: int):
        """For prefixes of any lengths and numbers of one: all bytes are constants but the digits."""
        signs = [(numbers // 10 ** (digits - 1 - j) % 10 + 48).astype(np.uint32) for j in range(digits)]
        made: dict[int, dict] = {}
        for prefix in prefixes:
            n = len(prefix)
            if n not in made:
                made[n] = {}
                for j, sign in enumerate(signs):
                    at = n + j
                    made[n][at // 4] = made[n].get(at // 4, np.uint32(0)) | (sign << np.uint32(at % 4 * 8))
            whole = prefix + b"\0" * digits + b"\x80"
            whole += b"\0" * (-(len(whole) + 8) % 64) + (8 * (n + digits)).to_bytes(8, "little")
            fixed = np.frombuffer(whole, "<u4").reshape(-1, 1)
            words = [(fixed[w] | made[n][w]) if w in made[n] else fixed[w] for w in range(len(fixed))]
            state = [np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
            for at in range(0, len(words), 16):
                state = compress(state, words[at : at + 16])
            yield state[0].byteswap()

    def draws(prefixes: list[bytes], start: int, stop: int):
        """Yields (place of the prefix, its numbers from start on), in pieces of numbers of equally many digits."""
        at = start
        while at < stop:
            digits = len(str(at))
            end = min(stop, 10**digits)
            for place, found in enumerate(of_length(prefixes, np.arange(at, end), digits)):
                yield place, found
            at = end

    return draws
