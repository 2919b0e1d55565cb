"""Alignment of one evaluation item with the words of one document (per-row helper of the leak search)."""

from __future__ import annotations

MISS, SKIP, REACH = -0.5, -0.3, 16
ANCHOR = 1.5


def best_passage(hits: list[tuple[int, int]], anchored: set[int]) -> tuple[int, int, list[tuple[int, int]]]:
    """(first offset, last offset, hits) of the best in-order local alignment through (position, offset) hits.

    Hits are chained when both position and offset rise, at most REACH positions on; a gap costs SKIP per word that one
    side has more than the other and MISS per word that both have, so that scattered or shuffled words don't add up.
    Anchors count more than other words.  No hits give (0, -1, []).
    """
    hits = sorted(set(hits))
    if not hits:
        return 0, -1, []
    value = [ANCHOR if o in anchored else 1.0 for _, o in hits]
    score, back = value[:], [-1] * len(hits)
    for i, (p, o) in enumerate(hits):
        for j in range(i - 1, -1, -1):
            q, r = hits[j]
            ahead, along = p - q, o - r
            if ahead > REACH:
                break
            if ahead > 0 and 0 < along <= REACH:
                gain = score[j] + value[i] + MISS * (min(ahead, along) - 1) + SKIP * abs(ahead - along)
                if gain > score[i]:
                    score[i], back[i] = gain, j
    at = max(range(len(hits)), key=score.__getitem__)
    chain = []
    while at >= 0:
        chain.append(hits[at])
        at = back[at]
    chain.reverse()
    return chain[0][1], chain[-1][1], chain
