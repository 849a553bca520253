"""Text to local time and back, independent of the session time zone.

All times are TIMESTAMP_NTZ. Text is brought into ISO shape first and converted with
``try_cast``: impossible dates and times become NULL, and no zone is ever applied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.text import MONTHS, month_number

DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def iso_to_ts(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.fff]`` text to time; year 0000 is no valid year."""
    return F.when(F.left(text, F.lit(4)) != "0000", text.try_cast("timestamp_ntz"))


def us_to_iso(text: Column) -> Column:
    """``MM/dd/yyyy HH:mm:ss`` to ISO shape."""
    return F.concat(
        F.substring(text, 7, 4), F.lit("-"), F.substring(text, 1, 2), F.lit("-"),
        F.substring(text, 4, 2), F.substring(text, 11, 9),
    )


# --- user formats ------------------------------------------------------------------

# The format letters, longest first, and the digits each accepts.
_TOKENS = {
    "yyyy": r"\d{4}", "yy": r"\d{2}",
    "MMM": "|".join(MONTHS), "MM": r"\d{2}", "M": r"\d{1,2}",
    "dd": r"\d{2}", "d": r"\d{1,2}",
    "HH": r"\d{2}", "H": r"\d{1,2}", "hh": r"\d{2}", "h": r"\d{1,2}",
    "mm": r"\d{2}", "m": r"\d{1,2}",
    "ss": r"\d{2}", "s": r"\d{1,2}",
    "zzz": r"\d{3}", "z": r"\d{1,3}",
    "AP": "AM|PM|am|pm|Am|Pm", "ap": "AM|PM|am|pm|Am|Pm",
}
_LEXER = re.compile(
    r"'(?P<quoted>(?:[^']|'')*)'|(?P<token>%s)|(?P<literal>.)"
    % "|".join(["d{3,4}", "M{4}", *sorted(_TOKENS, key=len, reverse=True), "t+"]),
    re.S,
)


@dataclass(frozen=True)
class TimeFormat:
    """A user time format, resolved on the driver to one regular expression."""

    pattern: str
    fields: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> TimeFormat:
        if not text:
            raise ValueError("the timestamp format is empty")
        parts, fields = [], []
        for match in _LEXER.finditer(text):
            token = match["token"]
            if token is None:
                literal = match["literal"] if match["quoted"] is None else match["quoted"].replace("''", "'")
                parts.append(re.escape(literal or "'"))
            elif token not in _TOKENS:
                raise ValueError(f"timestamp format token '{token}' is not supported: {text}")
            elif token[0] in {f[0] for f in fields}:
                raise ValueError(f"timestamp format repeats '{token}': {text}")
            else:
                parts.append(f"({_TOKENS[token]})")
                fields.append(token)
        return cls("^" + "".join(parts) + "$", tuple(fields))

    def parse(self, text: Column) -> Column:
        """NULL unless the whole text has this format and names a real time."""
        index = {field[0]: n for n, field in enumerate(self.fields, start=1)}
        ref = lambda letter, default: f"${index[letter]}" if letter in index else default
        century = "19" if "yy" in self.fields else ""
        hour = ref("H", ref("h", "00"))
        # One regular-expression pass moves the parts into a fixed order.
        parts = [century + ref("y", "1900"), ref("M", "01"), ref("d", "01"), hour, ref("m", "00"),
                 ref("s", "00"), ref("z", "0")]
        half = next((f for f in self.fields if f in ("AP", "ap")), None)
        if not half and "MMM" not in self.fields:
            layout = "{}-{}-{} {}:{}:{}.{}".format(*parts)
            return iso_to_ts(F.when(text.rlike(self.pattern), F.regexp_replace(text, self.pattern, layout)))

        layout = "|".join([*parts, ref(half[0], "") if half else ""])
        moved = F.split(F.when(text.rlike(self.pattern), F.regexp_replace(text, self.pattern, layout)), r"\|")
        part = lambda n: F.get(moved, F.lit(n))
        month = month_number(part(1)).cast("string") if "MMM" in self.fields else part(1)
        hour = part(3)
        if half:
            number = hour.try_cast("int")
            twelve = F.when(number.between(1, 12), number % 12)
            clock = F.when(F.upper(part(7)) == "PM", twelve + 12).otherwise(twelve)
            hour = (clock if "h" in index else number).cast("string")
        return iso_to_ts(F.concat(
            part(0), F.lit("-"), month, F.lit("-"), part(2), F.lit(" "), hour, F.lit(":"),
            part(4), F.lit(":"), part(5), F.lit("."), part(6)))


# --- bounds ------------------------------------------------------------------------

def parse_bound(text: str | datetime | None, local_zone: str = "UTC") -> datetime | None:
    """An ISO 8601 bound as a local time; a zone suffix is converted to ``local_zone``."""
    if text is None or text == "":
        return None
    if isinstance(text, datetime):
        moment = text
    else:
        try:
            moment = datetime.fromisoformat(text.strip())
        except ValueError as error:
            raise ValueError(f"not an ISO 8601 time: {text}") from error
    if moment.tzinfo is not None:
        moment = moment.astimezone(ZoneInfo(local_zone)).replace(tzinfo=None)
    rest = moment.microsecond % 1000
    return moment - timedelta(microseconds=rest) + timedelta(milliseconds=1 if rest >= 500 else 0)


def ntz_literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


# --- output texts ------------------------------------------------------------------

def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``; milliseconds are dropped."""
    return F.translate(F.left(ts.cast("string"), F.lit(19)), " ", "T")


def display_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS``."""
    text = ts.cast("string")
    padded = F.when(F.length(text) == 19, F.concat(text, F.lit(".000"))).otherwise(F.rpad(text, 23, "0"))
    return F.left(padded, F.lit(23))
