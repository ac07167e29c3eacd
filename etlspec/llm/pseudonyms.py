"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column, fresh, without

#: What to look for, first match first. Digits next to a match are no part of it.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\b",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api_key|apikey)[ ]?[=:][ ]?[\"']?)[^\s\"']{8,}+",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,}+(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every match of every kind holds one of these.
MARKS = "[0-9@=:]|AKIA|ASIA"
#: Days of the calendar's cycle of 400 years, a product of two numbers, and the day number of 1800-01-01.
CYCLE, LEFT, RIGHT, FIRST_DAY = 146_097, 189, 773, -62_091
#: Characters that one permutation covers; longer values are permuted piece by piece.
PIECE = 24


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, inside higher-order functions too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _permuted(key: str, kind: Column | str, a: Column, n_a: Column | int, b: Column, n_b: Column | int) -> Column:
    """A keyed permutation of the pairs (a, b), 0 <= a < n_a and 0 <= b < n_b: ten Feistel rounds that add."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    n_a, n_b = (F.lit(n).cast("long") if isinstance(n, int) else n for n in (n_a, n_b))

    def noise(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def round_(s: Column, i: Column) -> Column:
        return _let(
            F.pmod(s["a"] + F.pmod(noise(2 * i, s["b"]), n_a), n_a),
            lambda x: F.struct(x.alias("a"), F.pmod(s["b"] + F.pmod(noise(2 * i + 1, x), n_b), n_b).alias("b")),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(4)), start, round_)


def _letters(key: str, kind: str, plain: Column, leading: bool = False) -> Column:
    """``plain``, letters and digits only, with each character replaced by one of its class.

    Classes: digits, small letters, capitals; a-f alone in values that look
    hexadecimal; with ``leading``, 2-9 at places 0 and 3 of ten digits.
    """

    def cell(c: Column, i: Column, whole: Column) -> Column:
        code = F.ascii(c)
        hexadecimal = whole.rlike("^[0-9a-f]*$")
        lead = (F.length(whole) == 10) & i.isin(0, 3) & (code >= 50) if leading else F.lit(False)
        base = F.when(lead, 50).when(code < 58, 48).when(code < 91, 65).otherwise(97)
        radix = F.when(lead, 8).when(code < 58, 10).when((code >= 97) & hexadecimal, 6).otherwise(26)
        return F.struct((code - base).cast("long").alias("v"), radix.cast("long").alias("r"), base.alias("base"))

    def number(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s * x["r"] + x["v"])

    def size(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(1).cast("long"), lambda s, x: s * x["r"])

    def text(value: Column, cells: Column) -> Column:
        return F.aggregate(
            F.reverse(cells),
            F.struct(value.alias("rest"), F.lit("").alias("out")),
            lambda s, x: F.struct(
                F.call_function("div", s["rest"], x["r"]).alias("rest"),
                F.concat(F.chr((F.pmod(s["rest"], x["r"]) + x["base"]).cast("int")), s["out"]).alias("out"),
            ),
            lambda s: s["out"],
        )

    def piece(cells: Column, number_of_piece: Column) -> Column:
        half = (F.size(cells) / 2).cast("int")
        return _let(
            F.struct(F.slice(cells, F.lit(1), half).alias("x"), F.slice(cells, half + 1, F.size(cells)).alias("y")),
            lambda h: _let(
                _permuted(key, F.concat_ws("/", F.lit(kind), number_of_piece.cast("string"), F.size(cells).cast("string")), number(h["x"]), size(h["x"]), number(h["y"]), size(h["y"])),
                lambda s: F.concat(text(s["a"], h["x"]), text(s["b"], h["y"])),
            ),
        )

    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    cells = F.transform(chars, lambda c, i: cell(c, i, plain))
    pieces = F.sequence(F.lit(0), F.floor((F.length(plain) - 1) / PIECE).cast("int"))
    return _let(cells, lambda all_: F.array_join(F.transform(pieces, lambda j: piece(F.slice(all_, j * PIECE + 1, F.lit(PIECE)), j)), ""))


def _laid_out(value: Column, plain: Column) -> Column:
    """The letters and digits of ``plain`` in the places that they have in ``value``."""
    return F.aggregate(
        F.split(value, ""),
        F.struct(F.lit(1).alias("i"), F.lit("").alias("out")),
        lambda s, c: F.when(
            c.rlike("[0-9A-Za-z]"), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(plain, s["i"], F.lit(1))).alias("out"))
        ).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))),
        lambda s: s["out"],
    )


def _check_digit(body: Column) -> Column:
    """The last digit that makes a card number pass the Luhn test."""
    doubled = F.transform(
        F.split(F.reverse(body), ""),
        lambda c, i: F.when(i % 2 == 0, 2 * c.try_cast("int") - F.when(c.try_cast("int") > 4, 9).otherwise(0)).otherwise(c.try_cast("int")),
    )
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))), F.lit(10)), F.lit(10)).cast("string")


def _split_head(value: Column, pattern: str) -> tuple[Column, Column]:
    head = F.regexp_extract(value, pattern, 0)
    return head, F.substring(value, F.length(head) + 1, F.length(value))


def _of(kind: str, value: Column, key: str) -> Column:
    """The pseudonym of a match of ``kind``; null if the match is not valid."""
    alnum = lambda x: F.regexp_replace(x, "[^0-9A-Za-z]", "")
    if kind == "email":
        local, rest = F.substring_index(value, "@", 1), F.regexp_extract(value, "@.*$", 0)
        return F.when(alnum(local) != "", F.concat(_laid_out(local, _letters(key, kind, alnum(local))), rest))
    if kind == "access_key":
        return F.concat(F.substring(value, 1, 4), _letters(key, kind, F.substring(value, 5, 16)))
    if kind == "secret":
        head, rest = _split_head(value, r"^[A-Za-z_]+ ?[=:] ?[\"']?")
        return F.when(alnum(rest) != "", F.concat(head, _laid_out(rest, _letters(key, kind, alnum(rest)))))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: x.try_cast("long"))
        valid = F.forall(parts, lambda x: x < 256)
        pair = _let(parts, lambda p: _permuted(key, kind, F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), 65_536, F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), 65_536))
        octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
        return F.when(valid, _let(pair, lambda s: F.concat_ws(".", octets(s["a"]), octets(s["b"]))))
    if kind == "date":
        forms = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}

        def moved(form: str) -> Column:
            def render(day: Column) -> Column:
                offset = F.pmod(day - FIRST_DAY, F.lit(CYCLE))
                new = _let(_permuted(key, kind, F.floor(offset / RIGHT), LEFT, F.pmod(offset, F.lit(RIGHT)), RIGHT), lambda s: s["a"] * RIGHT + s["b"])
                return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (day - offset + new).cast("int")), form)

            date = F.try_to_date(value, form)
            return F.when(F.year(date).between(1000, 9799), _let(F.unix_date(date).cast("long"), render))

        out = F.lit(None).cast("string")
        for sign, form in forms.items():
            out = F.when(F.contains(value, F.lit(sign)), moved(form)).otherwise(out)
        return out
    if kind == "ssn":
        area, group, serial = (F.substring(value, at, n).try_cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

        def render(s: Column) -> Column:
            place = F.floor(s["a"] / 99)
            number = place + 1 + F.when(place >= 665, 1).otherwise(0)
            pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
            return F.concat_ws("-", pad(number, 3), pad(F.pmod(s["a"], F.lit(99)) + 1, 2), pad(s["b"] + 1, 4))

        return F.when(valid, _let(_permuted(key, kind, left, 898 * 99, serial - 1, 9999), render))
    if kind == "phone":
        head, rest = _split_head(value, r"^\+\d{1,3}(?=[ .(-])")
        count = F.length(alnum(value))
        return F.when(count.between(8, 15), F.concat(head, _laid_out(rest, _letters(key, kind, alnum(rest), leading=True))))
    return _cards(value, key)


def _cards(value: Column, key: str) -> Column:
    """A run of digit groups with each card number in it replaced; null if it holds none.

    A number of 13 to 19 digits that passes the Luhn test, made of whole groups:
    the whole run, or else, from left to right, the longest one from each group
    on whose groups have four digits or more, but for the last.
    """
    size = F.length(value)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    part = lambda start, end: F.substring(value, start, end - start + 1)
    sign = lambda at: F.substring(value, at, F.lit(1)).isin(" ", "-")

    def valid(number: Column) -> Column:
        return _let(digits(number), lambda d: F.length(d).between(13, 19) & (_check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)))

    def end_from(start: Column) -> Column:
        """Where the longest number from here ends; null if there is none."""
        reach = F.least(size, start + 36)  # 19 digits and 18 signs at most
        ends = F.filter(F.sequence(reach, F.least(reach, start + 12)), lambda j: ~sign(j) & ((j == size) | sign(j + 1)))
        grouped = lambda j: part(start, j).rlike(r"^(?:\d{4,}[ -])*\d+$")
        return F.get(F.filter(ends, lambda j: grouped(j) & valid(part(start, j))), F.lit(0))

    def step(s: Column, start: Column) -> Column:
        found = F.when(start >= s["next"], end_from(start))
        return _let(
            found,
            lambda end: F.when(end.isNull(), s).otherwise(
                F.struct((end + 1).alias("next"), F.concat(s["out"], part(s["next"], start - 1), _card(part(start, end), key)).alias("out"))
            ),
        )

    starts = F.filter(F.sequence(F.lit(1), size), lambda i: ~sign(i) & ((i == 1) | sign(i - 1)))
    scanned = F.aggregate(starts, F.struct(F.lit(1).alias("next"), F.lit("").alias("out")), step)
    rest = lambda s: F.when(s["next"] > 1, F.concat(s["out"], part(s["next"], size)))
    return F.when(valid(value), _card(value, key)).otherwise(_let(scanned, rest))


def _card(number: Column, key: str) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return _laid_out(number, _let(_letters(key, "card", body), lambda b: F.concat(b, _check_digit(b))))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms of the same format.

    Kinds: e-mail addresses (the part before the @), access keys, secrets after
    ``password=`` and the like (eight characters or more, up to a blank or a
    quote; ASCII letters and digits of it are replaced), IPv4 addresses, dates, US
    social security numbers, phone numbers and card numbers. Numbers and dates
    are validated (Luhn test, octets, calendar, number ranges); what fails stays
    as it is. In a run of digit groups of any length that is no card number, all
    runs of whole groups are tried, so cards among other numbers are found. A
    valid value becomes another valid value of its kind by a keyed permutation
    of that format's values, so equal values stay equal in all documents,
    different ones stay different, and separators stay in place. Values of more
    than ``PIECE`` characters are permuted piece by piece. A permutation may
    leave a value as it is, as likely as any other result; with very short
    values (an e-mail name of one letter) that is not rare.

    ``found_col`` is added: map<string, int> of the number of replacements by
    kind, empty if none; all cards in one run of digit groups count once. No shuffle, and no Python. ``key`` is part of the plan,
    so keep plans and event logs as safe as the key. Null texts stay null with
    no replacement; other columns and repeated rows pass through; a
    ``found_col`` already present is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = without(docs, [found_col])
    text = column(docs, text_col)

    def marked(kind: str, value: Column) -> Column:
        return _let(
            _of(kind, value, key),
            lambda new: F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, value).alias("new")),
        )

    def replace(value: Column) -> Column:
        done = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("new"))
        for kind, pattern in reversed(PATTERNS.items()):
            # a match is judged alone, so its pattern's conditions on neighbours hold
            mine = value.rlike(f"^(?:{pattern})$")
            done = F.when(mine, marked(kind, value)).otherwise(done)
        return done

    found = fresh(docs, "found")[0]
    likely = text.rlike(MARKS)
    matches = F.when(likely, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replace))
    out = docs.withColumn(found, matches)
    news = F.transform(F.col(found), lambda x: x["new"])
    gaps = F.split(column(docs, text_col), ANY, -1)
    joined = F.array_join(F.zip_with(gaps, news, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    new_text = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, joined).otherwise(column(docs, text_col))
    kinds = F.coalesce(F.filter(F.transform(F.col(found), lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    counts = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    columns = [new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, counts.alias(found_col))
