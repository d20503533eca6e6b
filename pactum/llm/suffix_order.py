"""Suffix order of several texts at once, by linear grouping.

A suffix's Lyndon prefix reaches to the next smaller suffix of its text.  Suffixes with the same Lyndon
prefix form a group, and groups stand in the order of those prefixes.  Within a group the order is that of
the suffixes behind the prefix, which are smaller: so one pass over the suffixes in ascending order, which
follows previous-smaller pointers from each to those it ends, emits every group's order.  Nothing is renamed
or sorted a second time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def lyndon_pointers(text: bytes) -> tuple[list[int], list[int]]:
    """(next smaller, previous smaller) suffix of each suffix; the text's length and -1 where there is none.

    Suffixes are visited from the last to the first, that is every group's longer prefixes after the
    shorter and larger ones that they are made of; a Lyndon word takes in the next while that is larger.
    """
    n = len(text)
    after, before = [n] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        first, j = text[i], i + 1
        while j < n:
            other = text[j]  # most words differ in their first byte
            if first > other or (first == other and text[i:j] >= text[j : after[j]]):
                break
            before[j] = i
            j = after[j]
        after[i] = j
    return after, before


def suffix_order(texts: Sequence[bytes]) -> list[int]:
    """Non-empty suffixes of all texts in ascending order; equal ones by text.

    Suffix k of text t is the number ``k + sum(len(x) + 1 for x in texts before t)``.
    """
    after: list[int] = []
    before: list[int] = []
    group: list[list[int] | None] = []
    groups: defaultdict[bytes, list[int]] = defaultdict(list)
    ends = []
    for text in texts:
        base = len(after)
        own_after, own_before = lyndon_pointers(text)
        after += [j + base for j in own_after]
        before += [j + base if j >= 0 else -1 for j in own_before]
        group += [groups[text[i:j]] for i, j in enumerate(own_after)]
        # the empty suffix at the end: smaller than all others, and no text's suffix reaches past it
        ends.append(len(after))
        after.append(-1)
        before.append(-1)
        group.append(None)
    order = []
    for end in ends:
        i = end - 1
        while i >= 0 and after[i] == end:
            group[i].append(i)
            i = before[i]
    # groups are written from the highest down, so that the lowest is taken from the end first
    ranked = [groups[word] for word in sorted(groups, reverse=True)]
    while ranked:
        members = ranked.pop()
        for suffix in members:  # grows while it is read where a prefix follows itself
            i = suffix - 1
            while after[i] == suffix:  # no suffix comes before the first: -1 is the last end, which has nothing after it
                group[i].append(i)
                i = before[i]
        order += members
    return order
