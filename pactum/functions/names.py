"""Column-name and type-name expressions, and the blocking keys of rename detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum import fixed
from pactum.functions.text import strip

EDIT_DISTANCE = 2   # names this close count as similar ...
EDIT_MIN_LENGTH = 4  # ... when both have at least this many characters
PIECES = EDIT_DISTANCE + 1
ANCHORS = (8, 4, 2, 1)  # sizes of a contained name's key: the largest that fits into it


def match_key(name: Column) -> Column:
    """Names match without regard to case."""
    return F.lower(name)


def name_form(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def type_form(name: Column) -> Column:
    """Normal form of a type name: trimmed, lower-cased, without ``(p,s)``, alias resolved."""
    base = strip(F.split(F.lower(strip(F.coalesce(name, F.lit("")))), r"\(", 2)[0])
    pairs = [F.lit(part) for item in fixed.TYPE_ALIASES.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), base), base)


def is_safe_promotion(expected: Column, actual: Column) -> Column:
    test = F.lit(False)
    for wanted, got in fixed.SAFE_PROMOTIONS:
        test = test | ((expected == wanted) & (actual == got))
    return test


def is_similar(left: Column, right: Column) -> Column:
    """Do two name forms look like the same column renamed?"""
    lengths = F.length(left), F.length(right)
    close = (
        (F.least(*lengths) >= EDIT_MIN_LENGTH) & (F.abs(lengths[0] - lengths[1]) <= EDIT_DISTANCE)
        & (F.levenshtein(left, right, EDIT_DISTANCE) >= 0)  # -1 beyond the threshold
    )
    return (left != "") & (right != "") & (left.contains(right) | right.contains(left) | close)


def rename_score(left: Column, right: Column) -> Column:
    """1 for equal name forms, falling with the edit distance."""
    return 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right))


# -- blocking keys ------------------------------------------------------------------------
# Two similar names always share at least one key, so an equi-join on the keys followed by
# ``is_similar`` is exact and never compares every missing column with every extra one.
#
# containment: the beginning of the contained name, in the largest anchor size that fits, is a window of the other
#   name.  A name emits windows only in the sizes that anchors on the other side have, mostly one or two.
# edit distance <= 2: cut the received name into three pieces; one of them survives two edits, and stands in the
#   expected name at a place that the piece's number and the difference in length bound (multi-match-aware
#   selection of the PASS-JOIN paper, Li et al., VLDB 2011).  A key holds the piece's number, the received name's
#   length and the piece, so a received name has three of them and an expected one at most 19.


def anchor_size(form: Column) -> Column:
    size = F.lit(ANCHORS[-1])
    for n in reversed(ANCHORS[:-1]):
        size = F.when(F.length(form) >= n, n).otherwise(size)
    return size


def anchor_key(form: Column, mark: str) -> Column:
    """The one key of a name that another may contain."""
    return F.concat(F.lit(mark), F.substring(form, F.lit(1), anchor_size(form)))


def window_keys(form: Column, sizes: Column, mark: str) -> Column:
    """Different keys of a name that may contain others, whose anchors have these sizes."""
    fitting = F.filter(sizes, lambda size: size <= F.length(form))
    windows = F.transform(fitting, lambda size: F.transform(
        F.sequence(F.lit(1), F.length(form) - size + 1), lambda start: F.concat(F.lit(mark), F.substring(form, start, size))))
    return F.array_distinct(F.flatten(windows))


def _pieces(length: str) -> list[tuple[str, str]]:
    """(start, size) of the three pieces of a name of this length, as SQL; the last ones are a letter longer where
    the length isn't a multiple of three."""
    base = f"CAST({length} DIV {PIECES} AS INT)"
    second, third = f"({base} + IF({length} % {PIECES} = 2, 1, 0))", f"({base} + IF({length} % {PIECES} >= 1, 1, 0))"
    return [("1", base), (f"({base} + 1)", second), (f"({base} + {second} + 1)", third)]


def _piece_key(number: int, length: str, piece: str) -> str:
    return f"concat('={number}:', CAST({length} AS STRING), ':', {piece})"


_NONE = "CAST(array() AS array<string>)"


def piece_keys(form: str) -> Column:
    """The three keys of a received name; none where it is too short for the edit rule."""
    length = f"length({form})"
    keys = [_piece_key(n, length, f"substring({form}, {start}, {size})") for n, (start, size) in enumerate(_pieces(length))]
    return F.expr(f"IF({length} >= {EDIT_MIN_LENGTH}, array({', '.join(keys)}), {_NONE})")


def selected_keys(form: str) -> Column:
    """The keys of all received names within the edit distance of an expected one, and few others."""
    length, found = f"length({form})", []
    for longer in range(-EDIT_DISTANCE, EDIT_DISTANCE + 1):
        other = f"({length} - {longer})"  # the received name's length
        for n, (start, size) in enumerate(_pieces(other)):
            tail = EDIT_DISTANCE - n
            first = f"greatest(1, {start} - {n}, {start} + {longer} - {tail})"
            last = f"least({length} - {size} + 1, {start} + {n}, {start} + {longer} + {tail})"
            starts = f"IF({other} >= {EDIT_MIN_LENGTH} AND {first} <= {last}, sequence({first}, {last}), CAST(array() AS array<int>))"
            found.append(f"transform({starts}, at -> {_piece_key(n, other, f'substring({form}, at, {size})')})")
    return F.expr(f"IF({length} >= {EDIT_MIN_LENGTH}, array_distinct(flatten(array({', '.join(found)}))), {_NONE})")


def expected_keys(form: str, received_sizes: Column) -> Column:
    """All keys of an expected name in the column `form`."""
    return F.concat(F.array(anchor_key(F.col(form), "<")), window_keys(F.col(form), received_sizes, ">"), selected_keys(form))


def received_keys(form: str, expected_sizes: Column) -> Column:
    """All keys of a received name in the column `form`."""
    return F.concat(F.array(anchor_key(F.col(form), ">")), window_keys(F.col(form), expected_sizes, "<"), piece_keys(form))
