"""Deep-shallow sorting of byte strings, and the repeats around shared anchors that the order shows."""

from __future__ import annotations

from bisect import bisect_left

#: Bytes that the multikey quicksort looks at before blind tries take over, and its step.
SHALLOW, STEP = 64, 8


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def blind_trie(texts: list[bytes], ids: list[int], order: list[int], lcp: list[int], before: int) -> None:
    """Append ``ids`` to ``order`` by their strings, and to ``lcp`` what each shares with the one before.

    The trie keeps branch depths and branching bytes only. A string descends blindly to some
    leaf, one comparison with that leaf gives the true depth, and the branch goes there.
    ``before`` is what the first string shares with the last one already in ``order``.
    """
    root: _Node | list[int] = [ids[0]]
    for i in ids[1:]:
        s, at = texts[i], root
        while isinstance(at, _Node):
            c = s[at.depth] if at.depth < len(s) else -1
            at = at.kids[c] if c in at.kids else next(iter(at.kids.values()))
        other = texts[at[0]]
        d = common(s, other)
        if d == len(s) == len(other):
            at.append(i)
            continue
        parent, at = None, root
        while isinstance(at, _Node) and at.depth < d:
            parent, key = at, s[at.depth]
            at = at.kids[key]
        mine = s[d] if d < len(s) else -1
        if isinstance(at, _Node) and at.depth == d:
            at.kids[mine] = [i]
            continue
        node = _Node(d)
        node.kids[other[d] if d < len(other) else -1] = at
        node.kids[mine] = [i]
        if parent is None:
            root = node
        else:
            parent.kids[key] = node
    stack: list[tuple[_Node | list[int], int]] = [(root, before)]
    while stack:
        at, share = stack.pop()
        if isinstance(at, _Node):
            kids = sorted(at.kids.items())
            for n in range(len(kids) - 1, -1, -1):
                stack.append((kids[n][1], at.depth if n else share))
        else:
            for n, i in enumerate(at):
                order.append(i)
                lcp.append(len(texts[i]) if n else share)


def deep_shallow(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, lcp): the strings' sorted order, and what each shares with the one before it (the first: 0).

    Multikey quicksort splits into smaller, equal and larger on words of ``STEP`` bytes down to
    ``SHALLOW`` bytes; what is still equal there, groups of long common prefixes, goes to blind tries.
    """
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(texts))), 0)] if texts else []
    while stack:
        ids, depth = stack.pop()
        if depth >= SHALLOW or len(ids) == 1:
            before = common(texts[order[-1]], texts[ids[0]]) if order else 0
            blind_trie(texts, ids, order, lcp, before)
            if order and len(order) > len(ids) and len(ids) > 1:
                at = len(order) - len(ids)
                lcp[at] = common(texts[order[at - 1]], texts[order[at]])
            continue
        words = {i: texts[i][depth : depth + STEP] for i in ids}
        pivot = words[ids[len(ids) // 2]]
        less = [i for i in ids if words[i] < pivot]
        more = [i for i in ids if words[i] > pivot]
        same = [i for i in ids if words[i] == pivot]
        if more:
            stack.append((more, depth))
        if len(pivot) < STEP:  # the strings end here: all equal
            stack.append((same, SHALLOW))
        else:
            stack.append((same, depth + STEP))
        if less:
            stack.append((less, depth))
    return order, lcp


def repeats(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each occurrence of an anchor, how far the repeats of ``length`` bytes around it reach.

    left: the bytes before the anchor, reversed; right: the bytes from it on. Two occurrences
    that share L bytes leftwards and R rightwards repeat a string of L + R bytes. Returns for each the
    largest L and R over the partners with L + R of at least ``length``, or (0, 0).

    Ranges of the right order are joined from the deepest common prefix up; the smaller one's
    members go into the left order of the larger one, where the best partner is a neighbour.
    """
    n = len(left)
    best_l, best_r = [0] * n, [0] * n

    def meet(a: int, b: int, r: int) -> None:
        m = common(left[a], left[b])
        if m + r >= length:
            for x in (a, b):
                if m > best_l[x]:
                    best_l[x] = m
                if r > best_r[x]:
                    best_r[x] = r

    if n == 2:
        meet(0, 1, common(right[0], right[1]))
        return list(zip(best_l, best_r))
    order, lcp = deep_shallow(right)
    place = [0] * n
    for p, i in enumerate(deep_shallow(left)[0]):
        place[i] = p
    at = sorted(range(n), key=place.__getitem__)
    home = list(range(n))
    kept = {i: [place[i]] for i in range(n)}

    def root(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    least = length - max(map(len, left))
    for p in sorted(range(1, n), key=lambda q: -lcp[q]):
        r = lcp[p]
        if r < least:
            break
        a, b = root(order[p - 1]), root(order[p])
        if len(kept[a]) < len(kept[b]):
            a, b = b, a
        large = kept[a]
        for q in kept.pop(b):
            k = bisect_left(large, q)
            if k:
                meet(at[q], at[large[k - 1]], r)
            if k < len(large):
                meet(at[q], at[large[k]], r)
            large.insert(k, q)
        home[b] = a
    return list(zip(best_l, best_r))
