"""Personal data in text: e-mail addresses, social security numbers, phone numbers.

An address is found and masked whole, however long its parts are, in time proportional to the text and in
constant stack.  To that end nothing in the pattern ever gives back what it has taken:

* an attempt starts only where no character of a local part stands before it, or where the last match ended,
  so that a long run of letters is walked through once and not once a letter;
* repetitions are possessive.  The engine runs a possessive group as a loop; a group that may give back is
  a recursion, which ends the JVM on an address of some thousand labels;
* the domain ends at the last label that begins with two letters.  It goes forward one such label at a time,
  as long as a look ahead sees another one, instead of taking all labels and going back.

The numbers have a bounded length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.functions.text import is_blank

# -- fixed values: what counts as personal data, and what replaces it -----------------------------
LOCAL = "A-Za-z0-9._%+-"   # characters of the part before the @
LABEL = "A-Za-z0-9-"       # characters of a domain's labels; the last one begins with two letters
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}\b"

WHOLE_MASK = "<masked>"    # for a value that is flagged as personal, of no kind that is known

_START = rf"(?:(?<![{LOCAL}])|\G)"
_OTHERS = rf"(?:\.(?![A-Za-z]{{2}})[{LABEL}]++)*+"   # labels at which a domain can't end
_ENDING = r"\.[A-Za-z]{2}"
EMAIL = (
    rf"{_START}[{LOCAL}]++@[{LABEL}]++"
    rf"(?:{_OTHERS}{_ENDING}[{LABEL}]*+(?={_OTHERS}{_ENDING}))*+"
    rf"{_OTHERS}{_ENDING}[A-Za-z]*+"
)


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: its pattern, the word that replaces it, and a test that every text which
    holds it passes (most texts don't)."""

    name: str
    pattern: str
    mask: str
    hint: str

    def _where_possible(self, value: Column, there: Column, otherwise: Column) -> Column:
        return F.when(value.contains(self.hint), there).otherwise(otherwise) if self.hint else there

    def count(self, value: Column) -> Column:
        found = F.coalesce(F.regexp_count(value, F.lit(self.pattern)), F.lit(0))
        return self._where_possible(value, found, F.lit(0))

    def masked(self, value: Column) -> Column:
        return self._where_possible(value, F.regexp_replace(value, self.pattern, self.mask), value)


KINDS = [Kind("email", EMAIL, "<email>", "@"), Kind("ssn", SSN, "<ssn>", "-"), Kind("phone", PHONE, "<phone>", "")]


def count_emails(value: Column) -> Column:
    return KINDS[0].count(value)


def count_ssns(value: Column) -> Column:
    return KINDS[1].count(value)


def count_phones(value: Column) -> Column:
    return KINDS[2].count(value)


def counts(value: Column) -> dict[str, Column]:
    """By kind, how often it occurs; 0 in a null text."""
    return {kind.name: kind.count(value) for kind in KINDS}


def mask(value: Column) -> Column:
    """The text with every address and number replaced by a word for its kind; null stays null."""
    for kind in KINDS:
        value = kind.masked(value)
    return value


def mask_flagged(value: Column) -> Column:
    """As `mask`, for a value that is known to be personal: where no kind is recognised in it, nothing of it
    is left.  Null and blank values stay."""
    seen = mask(value)
    return F.when((seen == value) & ~is_blank(value), F.lit(WHOLE_MASK)).otherwise(seen)
