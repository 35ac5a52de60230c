"""PII pseudonyms by format-preserving Feistel permutations, in DataFrame functions only.

One expression finds candidates; each is validated (Luhn, ISO 7064 mod 97,
octet ranges, calendar dates, the blocks in which social security numbers and
local phone numbers are given out; a + number by its 8 to 15 digits) and replaced within its own format. A keyed
alternating Feistel network runs over the candidate's symbols, each with its own
radix (10 for digits, 26 for letters of either case, 256 for octets; letters of
Latin-1 move among their like, others among their 16 code points), its round
function being SHA-256 of key, kind, round, position and the other half. It is a
permutation per format, so equal values get equal pseudonyms in every document
and different values stay different. Check digits are computed anew, so a valid
number stays valid. Dates permute among DAYS days from EPOCH on, dates before
and after within their own span of DAYS days; a date that is valid only with the
month first gets another such date. Where a permuted value would not be valid it
is permuted again, which keeps the whole a permutation of the valid values.

A card candidate is a whole run of digit groups; every valid number of 13 to 19
digits made of whole groups is replaced in it, from the left, the longest first.
An IBAN has its country's length; where the country is not known, or that length
does not fit, it is a run of groups, and if that fails, cards are sought in it.

Defined results: null text stays null, empty stays empty; candidates that fail
validation stay; phone numbers without + are found as 3-3-4 digits with
separators only; repeated rows are treated alike; other columns pass unchanged,
also if they have the names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of personal data.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
DATE = r"(?<![\w/-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4})(?![\w/-])"
#: Length of an IBAN by country, as registered.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_KNOWN = "(?:" + "|".join(rf"(?:{v.replace(' ', '|')})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, v in IBAN_LENGTH.items()) + ")(?![A-Za-z0-9])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
LOCAL_PHONE = r"(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|[ .]\d)"
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
#: What a run of groups must not take in: the other kinds, as they stand after a space or hyphen.
OTHER = rf"(?:{EMAIL}|{IP}|(?:\d{{4}}-\d\d-\d\d|\d\d/\d\d/\d{{4}}|\d{{3}}-\d\d-\d{{4}})(?![\w/-])|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?![\w-]|[ .]\d))"
IBAN_RUN = rf"[A-Z]{{2}}\d\d(?: ?(?!{IBAN_KNOWN}|{OTHER})[A-Z0-9]{{4}}){{2,7}}(?: ?(?!{OTHER})[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
IBAN = rf"(?<![A-Za-z0-9])(?:{IBAN_KNOWN}|{IBAN_RUN})"
CARD = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}})\d++(?!\w\d)(?:[ -](?!{OTHER})\d++(?!\w\d))*+"
CANDIDATE = "|".join((EMAIL, IP, DATE, IBAN, PHONE, LOCAL_PHONE, SSN, CARD))
EPOCH, SIDES = "1900-01-01", (292, 250)
DAYS = SIDES[0] * SIDES[1]
#: Turns of a date's permutation, at most, until the result has the date's own form; about two in five turns miss it with the month first.
TURNS = 64
# Numbers that are given out.
VALID_SSN = r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$"
VALID_LOCAL_PHONE = r"^\(?[2-9]\d{2}[) .-]{1,2}[2-9]\d{2}[ .-]\d{4}$"
ROUNDS = 6


def _draw(key: str, kind: str, rnd: Column, place: Column, other: Column, radix: Column) -> Column:
    """Pseudo-random number below radix."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), rnd.cast("string"), place.cast("string"), other)
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long"), radix)


def _feistel(symbols: Column, radices: Column, key: str, kind: str) -> Column:
    """Permuted symbols: array<bigint> below the radices, place by place."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    whole = F.zip_with(symbols, radices, lambda s, r: F.struct(s.cast("long").alias("s"), r.cast("long").alias("r")))
    start = F.struct(F.slice(whole, F.lit(1), half).alias("a"), F.slice(whole, half + 1, F.size(symbols)).alias("b"))

    def turn(side: Column, other: Column, rnd: Column) -> Column:
        seen = F.concat_ws(",", F.transform(other, lambda x: x["s"].cast("string")))
        return F.transform(side, lambda x, i: F.struct(F.pmod(x["s"] + _draw(key, kind, rnd, i, seen, x["r"]), x["r"]).alias("s"), x["r"].alias("r")))

    def step(st: Column, rnd: Column) -> Column:
        even = rnd % 2 == 0
        return F.struct(F.when(even, turn(st["a"], st["b"], rnd)).otherwise(st["a"]).alias("a"), F.when(even, st["b"]).otherwise(turn(st["b"], st["a"], rnd)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda st: F.transform(F.concat(st["a"], st["b"]), lambda x: x["s"]))


def _chars(m: Column) -> Column:
    return F.split(m, "")


def _class(c: Column) -> Column:
    """(first code point, number of code points) of the symbols that c moves among; null for characters that stay."""
    at = F.ascii(c)
    one = lambda lo, hi: F.struct(F.lit(lo).alias("base"), F.lit(hi - lo + 1).alias("size"))
    out = F.when(at.between(48, 57), one(48, 57)).when(at.between(97, 122), one(97, 122)).when(at.between(65, 90), one(65, 90))
    for lo, hi in ((0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF)):
        out = out.when(at.between(lo, hi), one(lo, hi))
    return out.when((at > 0xFF) & c.rlike(r"^[\p{L}\p{N}]$"), F.struct((at - at % 16).alias("base"), F.lit(16).alias("size")))


def _char(point: Column) -> Column:
    return F.when(point < 128, F.char(point)).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def _letters(m: Column, key: str, kind: str) -> Column:
    """m with its letters and digits permuted within their classes."""
    cs = F.transform(_chars(m), lambda c: F.struct(c.alias("c"), _class(c).alias("k")))
    live = F.filter(cs, lambda x: x["k"].isNotNull())
    out = _feistel(F.transform(live, lambda x: F.ascii(x["c"]) - x["k"]["base"]), F.transform(live, lambda x: x["k"]["size"]), key, kind)

    def put(st: Column, x: Column) -> Column:
        moves = x["k"].isNotNull()
        new = _char(F.get(st["o"], st["i"]) + x["k"]["base"])
        return F.struct(F.concat(st["t"], F.when(moves, new).otherwise(x["c"])).alias("t"), (st["i"] + moves.cast("int")).alias("i"), st["o"].alias("o"))

    return F.aggregate(cs, F.struct(F.lit("").alias("t"), F.lit(0).alias("i"), out.alias("o")), put, lambda st: st["t"])


def _among(m: Column, valid: str, key: str, kind: str) -> Column:
    """m, which matches `valid`, permuted until it does again; m itself if it doesn't."""
    turn = lambda st, i: F.when((i > 0) & st.rlike(valid), st).otherwise(_letters(st, key, kind))
    return F.when(m.rlike(valid), F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), m, turn)).otherwise(m)


def _luhn_sum(digits: Column, doubled_from_last: int) -> Column:
    """Luhn sum of a digit string; every second digit from the last on doubles, starting with the last if doubled_from_last is 0."""
    rev = F.transform(_chars(F.reverse(digits)), lambda c: c.cast("int"))
    two = F.transform(rev, lambda d, i: F.when((i + doubled_from_last) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(two, F.lit(0), lambda a, x: a + x)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _mod97(s: Column) -> Column:
    """Remainder of an alphanumeric string, letters counting from 10."""
    return F.aggregate(
        _chars(s),
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _card(m: Column, key: str) -> Column:
    body = _letters(F.substring(m, F.lit(1), F.length(m) - 1), key, "card")
    check = F.pmod(10 - _luhn_sum(_digits(body), 0) % 10, F.lit(10))
    return F.concat(body, check.cast("string"))


def _iban(m: Column, key: str) -> Column:
    land, rest = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    rest = _letters(rest, key, "iban")
    check = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), land, F.lit("00")))
    return F.concat(land, F.lpad(check.cast("string"), 2, "0"), rest)


def _ip(m: Column, key: str) -> Column:
    sym = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    out = _feistel(sym, F.transform(sym, lambda _: F.lit(256)), key, "ip")
    return F.concat_ws(".", F.transform(out, lambda x: x.cast("string")))


def _day(m: Column, fmt: str) -> Column:
    return F.datediff(F.try_to_date(m, fmt), F.to_date(F.lit(EPOCH)))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _date(m: Column, key: str) -> Column:
    """Permuted within its span of DAYS days, again until the year has four digits and, with the month first, the day is beyond 12; m itself if it is no date."""
    epoch = F.to_date(F.lit(EPOCH))
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
    days = F.array(*(F.when(F.year(F.try_to_date(m, f)) > 0, _day(m, f)) for f in forms))

    def fits(d: Column, form: Column) -> Column:
        day = F.date_add(epoch, d)
        return F.year(day).between(1, 9999) & ((form < 2) | (F.dayofmonth(day) > 12))

    def permuted(d: Column) -> Column:
        era = F.floor(d / DAYS) * DAYS
        out = _feistel(F.array(F.floor((d - era) / SIDES[1]), (d - era) % SIDES[1]), F.array(F.lit(SIDES[0]), F.lit(SIDES[1])), key, "date")
        return _bound(out, lambda o: (era + F.get(o, F.lit(0)) * SIDES[1] + F.get(o, F.lit(1))).cast("int"))

    def put(ds: Column, form: Column) -> Column:
        turn = lambda st, i: F.when((i > 0) & fits(st, form), st).otherwise(permuted(st))
        day = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), F.get(ds, form), turn)
        texts = lambda d: F.get(F.array(*(F.date_format(F.date_add(epoch, d), f) for f in forms)), form)
        return _bound(day, texts)

    first = lambda ds: F.array_min(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(ds, i).isNotNull()))
    return _bound(days, lambda ds: _bound(first(ds), lambda form: F.when(form.isNull(), m).otherwise(put(ds, form))))


def _cards(m: Column, key: str) -> Column:
    """m, a run of digit groups, with its valid card numbers replaced: whole groups of 13 to 19 digits, from the left, the longest first."""
    parts = F.regexp_extract_all(m, F.lit(r"[ -]?\d+"), F.lit(0))

    def at(ps: Column, i: Column) -> Column:
        span = lambda n: F.array_join(F.slice(ps, i + 1, n), "")
        valid = lambda d: F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0)
        most = F.least(F.lit(19), F.size(ps) - i)
        return F.array_max(F.filter(F.sequence(F.lit(1), most), lambda n: valid(_digits(span(n)))))

    def put(st: Column, i: Column, ps: Column) -> Column:
        def then(n: Column) -> Column:
            whole = F.array_join(F.slice(ps, i + 1, n), "")
            sep = F.regexp_extract(whole, "^[ -]?", 0)
            card = F.concat(sep, _card(F.regexp_replace(whole, "^[ -]", ""), key))
            found = F.struct(F.concat(st["t"], card).alias("t"), (i + n).cast("int").alias("k"))
            return F.when(n.isNotNull(), found).otherwise(F.struct(F.concat(st["t"], F.get(ps, i)).alias("t"), (i + 1).cast("int").alias("k")))

        return F.when(i < st["k"], st).otherwise(_bound(at(ps, i), then))

    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("k"))
    run = lambda ps: F.aggregate(F.sequence(F.lit(0), F.size(ps) - 1), start, lambda st, i: put(st, i, ps), lambda st: st["t"])
    return _bound(parts, run)


def _cards_within(m: Column, key: str) -> Column:
    """m with the card numbers of its runs of digit groups replaced."""
    runs = F.transform(F.regexp_extract_all(m, F.lit(f"({CARD})"), F.lit(1)), lambda x: _cards(x, key))
    return F.concat_ws("", F.zip_with(F.split(m, CARD, -1), runs, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself where it is not valid."""
    whole = lambda rx: m.rlike(f"^(?:{rx})$")
    tld = F.regexp_extract(m, r"\.[^.]*$", 0)
    compact = F.regexp_replace(m, " ", "")
    return (
        F.when(m.contains("@"), F.concat(_letters(F.substring(m, F.lit(1), F.length(m) - F.length(tld)), key, "email"), tld))
        .when(whole(IP), _ip(m, key))
        .when(whole(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}"), _date(m, key))
        .when(m.rlike("^[A-Z]") & (_mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1), _iban(m, key))
        .when(m.startswith("+"), F.concat(F.regexp_extract(m, r"^\+\d{1,3}", 0), _letters(F.regexp_replace(m, r"^\+\d{1,3}", ""), key, "phone")))
        .when(whole(r"\d{3}-\d\d-\d{4}"), _among(m, VALID_SSN, key, "ssn"))
        .when(whole(LOCAL_PHONE), _among(m, VALID_LOCAL_PHONE, key, "phone"))
        .otherwise(_cards_within(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal data in text_col replaced; count_col, if named, gets the number of replaced values.

    Who has the key can turn pseudonyms back, so it is the caller's to give and to guard.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))
    new = F.transform(found, lambda m: pseudonym(m, key))
    # split() takes the same expression, so the gaps are those around the candidates
    gaps = F.split(text, CANDIDATE, -1)
    joined = lambda new: F.concat_ws("", F.zip_with(gaps, new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))))
    changed = lambda new: F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    may = text.rlike(r"[0-9][ .()/-]{0,2}[0-9]|@")
    both = F.when(may, _bound(new, lambda x: F.struct(joined(x).alias("t"), changed(x).alias("n"))))
    taken = {*docs.columns, count_col}
    tmp = next(f"_pii{i}" for i in range(len(taken) + 1) if f"_pii{i}" not in taken)
    out = docs.withColumn(tmp, both)
    put = F.when(F.col(tmp).isNotNull(), F.col(tmp)["t"]).otherwise(text).alias(text_col)
    cols = [put if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        cols.append(F.coalesce(F.col(tmp)["n"], F.lit(0)).alias(count_col))
    return out.select(*cols)
