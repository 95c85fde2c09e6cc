"""Word shingles of one text, hashed inside Spark tasks."""

import numpy as np
import xxhash


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words joined by spaces, in order, with repeats.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than `width` make one
    shingle, none (or NULL) makes none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[min(width, len(words)) - 1 :].tolist()
    first = (ends - sizes)[: len(last)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype=np.uint64
    )
