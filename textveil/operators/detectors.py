"""Detectors of personal data in Russian text: patterns, check digits and keywords, as data for one Column expression.

A text is scanned once for stretches of digits (with the signs and blanks that stand between digits of one number) and once for runs of
the characters that secrets have. Rules look into these stretches, not into the text, each only into those of its length; runs of
digits without anything between them are found once in a stretch and go to the rules by their number. Only addresses and a few patterns
with words or letters go through whole texts, behind a cheap test. Contexts are cut from the text in pieces.

A rule is a row of constants: its pattern, and what words near a match make of its score. One expression serves all of them, so a plan
doesn't grow with the rules. The list of detectors is an argument of detect(), so own ones can be added; names and addresses come from
a table of spans that any tagger may have made.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.scan import bound, chunked, cleaned, cut, found, holds_any, neighbourhoods, one_edit_away
from . import resolve

SPANS = "array<struct<entity_type:string,start:int,end:int,score:double>>"

# Keywords, as stems where endings vary.
INN_WORDS = ["инн", "идентификацинн", "налогоплательщик"]
SNILS_WORDS = ["снилс", "страхов", "пенсионн"]
OGRN_WORDS = ["огрн", "государственный регистрационный"]
OGRNIP_WORDS = ["огрнип", "предпринимател", "огрн ип"]
KPP_WORDS = ["кпп", "причина постановки", "причины постановки"]
PASSPORT_WORDS = ["паспорт", "паспортн", "сери", "документ", "удостовер"]
PHONE_WORDS = ["телефон", "тел", "мобильн", "сотов", "звонок", "звонк", "позвон"]
CARD_WORDS = ["карт", "card", "visa", "mastercard", "мир", "maestro"]
CVC_WORDS = [
    "cvc", "cvv", "cvс", "cvc2", "cvv2", "cvv/cvc", "cvc/cvv", "security code", "card verification",
    "цвц", "цвс", "квв", "квс", "свс", "свц", "код карты", "секретный код", "код безопасност",
    "обратной сторон", "обратная сторон", "оборот", "сзади карт", "с обратной", "на обороте", "на обратной",
    "три цифр", "трёх цифр", "трехзначн", "трёхзначн", "код подтвержден", "код верификац", "цифры карт", "цифр карт",
]
TOKEN_WORDS = [
    "токен", "ключ", "пароль", "секрет", "подтвержд", "активац", "авторизац", "token", "key", "secret", "api", "bearer", "access",
    "refresh", "authorization", "credentials", "auth", "confirm", "password", "passphrase",
]
STRONG_TOKEN_WORDS = ["токен:", "ключ:", "token:", "secret:", "api_key:", "bearer ", "api key:", "api token:"]
OTP_WORDS = ["код", "code", "подтвержд", "confirm", "активац", "otp", "пин", "pin"]
NOT_OTP_WORDS = ["паспорт", "серия", "номер карты", "карта", "руб", "₽", "списали", "платёж"]
# Known formats of secrets with their base scores, in the order in which they are tried.
TOKEN_FORMATS = [
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0.95),
    (r"(?U:\b)gh[psoure]_[A-Za-z0-9]{36,}(?U:\b)", 0.95),
    (r"(?U:\b)github_pat_[A-Za-z0-9_]{20,}(?U:\b)", 0.95),
    (r"(?U:\b)glpat-[A-Za-z0-9_-]{20,}(?U:\b)", 0.95),
    (r"(?U:\b)sk-[A-Za-z0-9\-]{20,}(?U:\b)", 0.95),
    (r"(?U:\b)(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,}(?U:\b)", 0.95),
    (r"(?U:\b)AKIA[0-9A-Z]{16}(?U:\b)", 0.95),
    (r"(?U:\b)hf_[A-Za-z0-9]{20,}(?U:\b)", 0.95),
    (r"(?U:\b\d{8,10}):[A-Za-z0-9_-]{35}(?U:\b)", 0.95),
    (r"(?U:\b)[A-Za-z][A-Za-z0-9]{1,19}[-_][A-Za-z0-9]{16,}(?U:\b)", 0.85),
]
TYPES = ["ADDRESS", "BANK_CARD_NUMBER", "EMAIL", "NAME", "PHONE_NUMBER", "TOKEN", "INN", "KPP", "OGRN", "OGRNIP", "SNILS", "PASSPORT_NUMBER", "CVC"]

#: Stretches that may hold a number: digits and what may stand between or before them.
DIGITS = r"[+(]?\p{Nd}[\p{Nd}\p{IsWhite_Space}()\-+]*"
#: Runs that may hold a secret, and a short secret of three parts.
TOKENS = r"(?<![A-Za-z0-9+/=_.:\-])[A-Za-z0-9+/=_.:\-]{16,}|eyJ[A-Za-z0-9_.\-]{7,12}"
#: A run of digits that is a word of its own.
RUN = r"(?U)\b\d{3,15}\b"
REACH = 12


@dataclass(frozen=True)
class Rule:
    """One pattern of a detector, and how its matches score.

    ``within`` tells where matches lie: in the ``text``, wholly in a stretch of DIGITS or TOKENS (``digits``, ``tokens``), from digits on
    and less than REACH characters beyond their stretch (``beyond``), or they are a whole RUN of digits (``run``), against which
    ``pattern`` is held then. ``gate`` is a pattern that any match implies, of the text or
    of the stretch; no match is shorter than ``least`` or, in a run, longer than ``most``. ``check`` names a test of the match.

    A match scores ``near`` if one of ``words`` stands within ``close`` characters of it, else ``far`` if one of ``more`` stands within
    ``wide``, else ``none``; null drops it, and so does a word of ``unless`` within ``wide``, or the test named by ``needs``. With
    ``fuzzy``, a word one edit from one of ``words`` that has no blank counts too. ``shape`` names what the match itself adds to the
    score, 1 at most.
    """

    pattern: str
    within: str = "text"
    gate: str = ""
    least: int = 1
    most: int = 0
    check: str = ""
    shape: str = ""
    needs: str = ""
    words: tuple[str, ...] = ()
    more: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    fuzzy: bool = False
    close: int = 30
    wide: int = 60
    near: float | None = None
    far: float | None = None
    none: float | None = None


_RULE = "array<struct<rank:int,entity:string,pattern:string,within:string,gate:string,least:int,most:int,check:string,shape:string,needs:string,words:array<string>,more:array<string>,unless:array<string>,single:array<string>,known:string,close:int,wide:int,near:double,far:double,none:double>>"


@dataclass(frozen=True)
class Detector:
    entity: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def by_context(words: list[str], near: float, far: float, none: float | None = None, fuzzy: bool = True) -> dict:
    return {"words": tuple(words), "more": tuple(words), "near": near, "far": far, "none": none, "fuzzy": fuzzy}


def constant(score: float) -> dict:
    return {"none": score}


def _passport(base: float) -> dict:
    return by_context(PASSPORT_WORDS, round(min(base + 0.4, 1.0), 2), round(base + 0.2, 2), base if base >= 0.5 else None)


def _known_token(base: float) -> dict:
    return {"words": tuple(STRONG_TOKEN_WORDS), "more": tuple(TOKEN_WORDS), "close": 60, "near": min(0.97, round(base + 0.05, 2)), "far": min(0.95, round(base + 0.02, 2)), "none": base}


_RANDOM_TOKEN = {"words": tuple(STRONG_TOKEN_WORDS), "more": tuple(TOKEN_WORDS), "close": 60, "near": 0.90, "far": 0.75, "none": 0.65, "needs": "random"}
_ONE_TIME_CODE = {"words": tuple(OTP_WORDS), "unless": tuple(NOT_OTP_WORDS), "close": 40, "wide": 40, "near": 0.80}


@dataclass(frozen=True)
class Plan:
    """A numbering plan: what follows ``prefix`` (country code and more) in an international number has ``low`` to ``high`` digits, and the one ``at`` places further is one of ``digits``.

    No number has a plan with a ``high`` of 0.
    """

    prefix: str
    region: str
    low: int
    high: int
    at: int = 0
    digits: str = "0123456789"


# Lengths of national numbers by country code.
_LENGTHS = {
    "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "40": (9, 9), "41": (9, 9), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9),
    "52": (10, 10), "55": (10, 11), "61": (9, 9), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "353": (7, 9), "355": (8, 9), "359": (7, 9),
    "370": (8, 8), "371": (8, 8), "372": (7, 8), "373": (8, 8), "374": (8, 8), "375": (9, 9), "380": (9, 9), "381": (8, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "971": (8, 9), "972": (8, 9),
    "976": (8, 8), "992": (9, 9), "993": (8, 8), "994": (9, 9), "995": (9, 9), "996": (9, 9), "998": (9, 9),
}
#: The longest prefix decides. Russian codes of places and of mobile networks; Kazakhstan's beside them; area codes of +1, whose exchanges
#: don't begin with 0 or 1 and of which those that end in 11 are services; British numbers, none of which begins with 0, 4 or 6. Codes that
#: are not here may have any length.
PLANS = (
    Plan("", "", 8, 15), Plan("7", "RU", 0, 0), *[Plan(f"7{d}", "RU", 9, 9) for d in "3489"], *[Plan(f"7{d}", "KZ", 9, 9) for d in "67"],
    Plan("1", "US", 0, 0), *[Plan(f"1{d}", "US", 9, 9, 2, "23456789") for d in "23456789"], *[Plan(f"1{d}11", "US", 0, 0) for d in "23456789"],
    Plan("44", "GB", 9, 10, 0, "1235789"), *[Plan(code, code, low, high) for code, (low, high) in _LENGTHS.items()],
)


def plans_from(table: DataFrame) -> tuple[Plan, ...]:
    """Plans from a table (prefix, region, low, high, at, digits), which every call for a number looks at: at most 10,000 rows."""
    rows = table.select("prefix", "region", "low", "high", "at", "digits").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 plans")
    return tuple(Plan(*r) for r in rows)


def plan_of(digits: Column, plans: tuple[Plan, ...] = PLANS) -> Column:
    """The plan (prefix, region, low, high, at, digits) of an international number without its sign: that of its longest prefix; null if none has any."""
    levels: dict[int, dict[str, dict]] = {}
    for p in plans:
        levels.setdefault(len(p.prefix), {})[p.prefix] = asdict(p)
    table = lambda n: F.from_json(F.lit(json.dumps(levels[n])), "map<string,struct<prefix:string,region:string,low:int,high:int,at:int,digits:string>>")
    return F.coalesce(*[F.try_element_at(table(n), F.left(digits, F.lit(n))) for n in sorted(levels, reverse=True)])


def fits_plan(digits: Column, plans: tuple[Plan, ...] = PLANS, region: str | None = None) -> Column:
    """Whether an international number has a plan (of a region) and is as that plan says."""

    def fits(p: Column) -> Column:
        rest = F.length(digits) - F.length(p["prefix"])
        ok = rest.between(p["low"], p["high"]) & (p["high"] > 0) & F.contains(p["digits"], F.substr(digits, F.length(p["prefix"]) + p["at"] + 1, F.lit(1)))
        return ok if region is None else ok & (p["region"] == region)

    return F.coalesce(bound(plan_of(digits, plans), fits), F.lit(False))


def is_phone(raw: Column, plans: tuple[Plan, ...] = PLANS, region: str = "RU", code: str = "7", trunk: str = "8", national: int = 10) -> Column:
    """A number with + that fits its country's plan, or one of the home region: national digits, with country code or trunk prefix before them or not."""

    def check(d: Column) -> Column:
        n = F.length(d)
        home = F.when(n == national, F.concat(F.lit(code), d)).when((n == national + 1) & F.left(d, F.lit(1)).isin(code, trunk), F.concat(F.lit(code), F.substr(d, F.lit(2))))
        fits = F.when(F.startswith(raw, F.lit("+")), fits_plan(d, plans)).otherwise(bound(home, lambda h: fits_plan(h, plans, region)))
        return F.when(raw.isNotNull(), fits)

    return bound(checks.digits_of(raw), check)


def _phone_shape(value: Column) -> Column:
    n = F.length(checks.digits_of(value))
    return F.when(F.regexp_like(value, F.lit(r"[+()\-]|\d \d")), 0.65).when(n == 11, 0.50).otherwise(0.40) + 0.15


#: Tests of a match and scores of its shape, by name: functions of its text.
CHECKS: dict[str, Callable[[Column], Column]] = {"inn": checks.is_valid_inn, "snils": checks.is_valid_snils, "ogrn": checks.is_valid_ogrn, "ogrnip": checks.is_valid_ogrnip, "luhn": checks.is_valid_luhn, "phone": is_phone}
SHAPES: dict[str, Callable[[Column], Column]] = {"phone": _phone_shape, "card": lambda v: F.when(F.length(checks.digits_of(v)) == 16, 0.7).otherwise(0.5)}
#: Tests of a match by its text and whether one of ``more`` stands near: random words are longer and more even without one.
NEEDS: dict[str, Callable[[Column, Column], Column]] = {"random": lambda v, told: (F.length(v) >= 16) & F.when(told, checks.entropy(v) >= 3.3).otherwise((F.length(v) >= 32) & (checks.entropy(v) >= 3.5))}


#: A run of token characters; one that is under 16 characters long, dots included, is passed over at once.
_CANDIDATE = r"(?<![A-Za-z0-9+/=_\-])(?=[A-Za-z0-9+/=_.\-]{16})[A-Za-z0-9+/=_\-]+(?:\.[A-Za-z0-9+/=_\-]+)*"
_CARD_SHAPE = r"(?U)\b\d(?:[ \-]?\d){12,18}\b"
_PHONE_SHAPE = r"(?<![\d+])(?:\+1(?:[ ()\-]{0,2}\d){10}(?!\d)|\+\d(?:[ ()\-]{0,2}\d){7,14}|[78](?:[ ()\-]{0,2}\d){10}|\(?\d{3}\)?(?:[ \-]?\d){7})(?!\d)"

#: What each of the known formats begins with or holds, in their order.
_FORMAT_GATES = (r"eyJ", r"gh[psoure]_", r"github_pat_", r"glpat-", r"sk-", r"k_(?:live|test)_", r"AKIA", r"hf_", r":[A-Za-z0-9_-]{35}", r"[-_][A-Za-z0-9]{16}")


TOKEN = Detector("TOKEN", (*[Rule(p, "tokens", g, **_known_token(b)) for (p, b), g in zip(TOKEN_FORMATS, _FORMAT_GATES, strict=True)], Rule(_CANDIDATE, "tokens", r"[A-Za-z0-9+/=_.\-]{16}", 16, **_RANDOM_TOKEN), Rule("", "run", "", 4, 8, **_ONE_TIME_CODE)))
INN = Detector("INN", tuple(Rule("", "run", "", n, n, "inn", **by_context(INN_WORDS, 0.9, 0.7)) for n in (12, 10)))
SNILS = Detector("SNILS", (Rule(r"(?U)\b\d{3}-\d{3}-\d{3}\s\d{2}\b", "digits", "-", 14, **constant(0.9)), Rule("", "run", "", 11, 11, "snils", **by_context(SNILS_WORDS, 1.0, 0.85))))
OGRN = Detector("OGRN", (Rule("^[15]", "run", "", 13, 13, "ogrn", **by_context(OGRN_WORDS, 1.0, 0.85)), Rule(r"(?U)\b[15]-\d{2}-\d{2}-\d{7}-\d\b", "digits", "-", 17, 0, "ogrn", **by_context(OGRN_WORDS, 1.0, 0.85))))
OGRNIP = Detector("OGRNIP", (Rule("^[34]", "run", "", 15, 15, "ogrnip", **by_context(OGRNIP_WORDS, 1.0, 0.85)), Rule(r"(?U)\b[34]-\d{2}-\d{2}-\d{9}-\d\b", "digits", "-", 19, 0, "ogrnip", **by_context(OGRNIP_WORDS, 1.0, 0.85))))
KPP = Detector("KPP", (Rule(r"(?iU)\b\d{4}[\dA-Z]{2}\d{3}\b", "beyond", "", 4, **by_context(KPP_WORDS, 0.9, 0.7)), Rule(r"(?iU)\b\d{4}-[\dA-Z]{2}-\d{3}\b", "beyond", "-", 4, **by_context(KPP_WORDS, 1.0, 0.8))))
PASSPORT = Detector("PASSPORT_NUMBER", (Rule(r"(?iU)серия\s+\d{4}\s+номер\s+\d{6}", "text", "[Сс][Ее][Рр][Ии][Яя]", **constant(0.90)), *[Rule(p, "digits", "", 11, **_passport(b)) for p, b in ((r"(?U)\b\d{2}\s\d{2}\s\d{6}\b", 0.70), (r"(?U)\b\d{4}\s\d{6}\b", 0.55), (r"(?U)\b\d{4}[-]\d{6}\b", 0.55))], Rule("", "run", "", 10, 10, **_passport(0.30))))
CARD = Detector("BANK_CARD_NUMBER", (Rule(_CARD_SHAPE, "digits", "", 13, 0, "luhn", "card", **by_context(CARD_WORDS, 0.3, 0.15, 0.0, fuzzy=False)),))
PHONE = Detector("PHONE_NUMBER", (Rule(_PHONE_SHAPE, "digits", "", 8, 0, "phone", "phone", **by_context(PHONE_WORDS, 0.15, 0.10, 0.0, fuzzy=False)),))
EMAIL = Detector("EMAIL", (Rule(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "text", "@", **constant(0.9)),))
CVC = Detector("CVC", (Rule("", "run", "", 3, 4, **by_context(CVC_WORDS, 0.7, 0.5, fuzzy=False)),))
#: In the order of registration, which decides ties of score between equal spans.
ALL = (TOKEN, INN, SNILS, OGRN, OGRNIP, KPP, PASSPORT, CARD, PHONE, EMAIL, CVC)
EXTERNAL_SCORE = 0.85


def first_of_equal(spans: Column) -> Column:
    """Of spans with one place the first, in the order they come in."""
    return resolve.first_of_place(spans, lambda s: F.lit(0))


def rule_rows(detectors) -> list[dict]:
    """All rules as rows, numbered in their order."""
    out = []
    for d in detectors:
        for r in d.rules:
            single = [w for w in r.words if " " not in w] if r.fuzzy else []
            row = asdict(r) | {"rank": len(out), "entity": d.entity, "single": single, "known": neighbourhoods(single)}
            row.pop("fuzzy")
            out.append(row)
    return out


def _rules(rows: list[dict]) -> Column:
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), _RULE)


def _named(name: Column, used: set[str], functions: dict, otherwise, *values: Column) -> Column:
    """What the function of a name says of ``values``; of functions, only those that a rule names stand in the expression."""
    out = None
    for key in sorted(used - {""}):
        out = F.when(name == key, functions[key](*values)) if out is None else out.when(name == key, functions[key](*values))
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def found_spans(text: Column, detectors=ALL) -> Column:
    """All findings in a text without marks, in the order of the rules; of secrets only the first of equal places."""
    rows = rule_rows(detectors)
    used = lambda field: {r[field] for r in rows}
    of = lambda *where: [r for r in rows if r["within"] in where]
    moved = lambda spans, by, rule: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"), rule.alias("r")))
    hits = lambda t, r: found(t, r["pattern"], (r["gate"] == "") | F.regexp_like(t, r["gate"]))
    kind = "array<struct<start:int,end:int,value:string,r:" + _RULE[6:-1] + ">>"

    # stretches with a character to each side, as patterns look there, and one with all that a match can reach
    widths = {"digits": 1, "beyond": REACH, "tokens": 1}
    wanted = lambda *where: [w for w in where if of(w)]

    def scan(pattern: str, gate: Column, kinds: list[str]) -> Column:
        one = lambda s, k: F.struct(F.lit(k).alias("within"), (s["end"] - s["start"]).alias("size"), F.greatest(s["start"] - 1, F.lit(0)).alias("at"), s["end"].alias("end"), (s["end"] + widths[k]).alias("to"))
        return F.flatten(F.transform(found(text, pattern, gate), lambda s: F.array(*[one(s, k) for k in kinds])))

    def inside(stretches: Column) -> Column:
        inner = []
        if of("digits", "beyond", "tokens"):
            fits = lambda r: F.filter(stretches, lambda s: (s["within"] == r["within"]) & (s["size"] >= r["least"]))
            begun = lambda s, r: F.filter(moved(hits(s["text"], r), s["at"], r), lambda x: x["start"] < s["end"])  # a match belongs to the stretch that it begins in
            inner.append(F.flatten(F.transform(_rules(of("digits", "beyond", "tokens")), lambda r: F.flatten(F.transform(fits(r), lambda s: begun(s, r))))).cast(kind))
        if of("run"):
            takes = lambda x: F.filter(_rules(of("run")), lambda r: F.length(x["value"]).between(r["least"], r["most"]) & ((r["pattern"] == "") | F.regexp_like(x["value"], r["pattern"])))
            routed = lambda x, by: F.transform(takes(x), lambda r: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"), r.alias("r")))
            digits = F.filter(stretches, lambda s: (s["within"] == "digits") & (s["size"] >= 3))
            inner.append(F.flatten(F.transform(digits, lambda s: F.flatten(F.transform(found(s["text"], RUN), lambda x: routed(x, s["at"]))))).cast(kind))
        return F.concat(*inner)

    def in_stretches() -> Column:
        # words are seldom that long, and a blank is told faster than a character of a secret
        has = lambda p: F.regexp_like(text, F.lit(p))
        scans = [scan(DIGITS, has(r"\p{Nd}"), sorted({"digits", *wanted("beyond")}))] if of("digits", "run", "beyond") else []
        scans += [scan(TOKENS, has(r"\S{16}") | F.contains(text, F.lit("eyJ")), ["tokens"])] if of("tokens") else []
        cut_out = lambda s, c: F.struct(s["within"].alias("within"), s["size"].alias("size"), s["at"].alias("at"), s["end"].alias("end"), cut(c, s["at"], s["to"]).alias("text"))
        texts = lambda all_: bound(chunked(text), lambda c: bound(F.transform(all_, lambda s: cut_out(s, c)), inside))
        least = min(3 if r["within"] == "run" else r["least"] for r in of("digits", "run", "beyond", "tokens"))
        return bound(F.filter(F.concat(*scans), lambda s: s["size"] >= least), lambda all_: F.when(F.size(all_) > 0, texts(all_)).otherwise(F.array().cast(kind)))

    parts = []
    if of("text"):
        parts.append(F.flatten(F.transform(_rules(of("text")), lambda r: moved(hits(text, r), F.lit(0), r))).cast(kind))
    if of("digits", "run", "beyond", "tokens"):
        parts.append(in_stretches())
    matches = F.concat(*parts) if parts else F.array().cast(kind)

    def scored(chunks: Column) -> Callable[[Column], Column]:
        def of_match(m: Column) -> Column:
            r, s, e = m["r"], m["start"], m["end"]
            left = F.greatest(s - r["wide"], F.lit(0))
            inner = F.greatest(s - r["close"], F.lit(0))

            def level(wide: Column) -> Column:
                close = F.substr(wide, inner - left + 1, e + r["close"] - inner)
                fuzzy = lambda x: (F.size(r["single"]) > 0) & one_edit_away(F.split(x, r"(?U)\W+", -1), r["single"], r["known"])
                told = holds_any(wide, r["more"])
                out = F.when(holds_any(close, r["words"]) | fuzzy(close), r["near"]).when(told | ((F.size(r["more"]) > 0) & fuzzy(wide)), r["far"]).otherwise(r["none"])
                bad = holds_any(wide, r["unless"])
                return F.when(~bad & _named(r["needs"], used("needs"), NEEDS, True, m["value"], told), out)

            shape = _named(r["shape"], used("shape"), SHAPES, 0.0, m["value"])
            context = F.when(F.size(r["words"]) + F.size(r["more"]) > 0, bound(F.lower(cut(chunks, left, e + r["wide"])), level)).otherwise(r["none"])
            total = bound(shape + context, lambda x: F.round(F.when(x > 1.0, 1.0).otherwise(x), 2))  # null where the match is dropped
            return F.struct(r["rank"].alias("rank"), s.alias("start"), e.alias("end"), r["entity"].alias("entity_type"), total.alias("score"))

        return of_match

    def judged(all_: Column) -> Column:
        valid = F.filter(all_, lambda m: _named(m["r"]["check"], used("check"), CHECKS, True, m["value"]))
        told = bound(chunked(text), lambda c: F.sort_array(F.filter(F.transform(valid, scored(c)), lambda s: s["score"].isNotNull())))
        spans = F.transform(told, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).cast(SPANS)
        return resolve.once_per(spans, lambda s, i: F.when(s["entity_type"] == "TOKEN", -1).otherwise(i), lambda s: F.lit(0))

    none = F.array().cast(SPANS)
    return F.coalesce(bound(matches, lambda all_: F.when(F.size(all_) > 0, judged(all_)).otherwise(none)), none)


def with_external(docs: DataFrame, external: DataFrame | None, key: str) -> DataFrame:
    """Adds __external: a document's spans from a table (key, entity_type, start, end[, score]). One row for each document is joined."""
    if external is None:
        return docs.withColumn("__external", F.array().cast(SPANS))
    score = F.coalesce(F.col("score").cast("double"), F.lit(EXTERNAL_SCORE)) if "score" in external.columns else F.lit(EXTERNAL_SCORE)
    one = F.struct("entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), score.alias("score"))
    lists = external.groupBy(F.col(key).alias("__id")).agg(F.sort_array(F.collect_list(one)).cast(SPANS).alias("__external"))
    return docs.join(lists, F.col(key) == F.col("__id"), "left").drop("__id").withColumn("__external", F.coalesce("__external", F.array().cast(SPANS)))


def detect(docs: DataFrame, text: str = "text", detectors=ALL, external: DataFrame | None = None, entities: list[str] | None = None, min_score: float | None = None, key: str = "doc_id", overlap: str = "containment") -> DataFrame:
    """Adds ``spans`` to ``docs``: all findings after resolution, the longest first; type and score filters come last.

    No shuffle but the join with ``external``, if given. A null text has no findings; an empty list of ``entities`` means all.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    got = with_external(docs, external, key).withColumn("__clean", cleaned(F.col(text)))
    got = got.withColumn("__raw", F.concat("__external", found_spans(F.col("__clean"), detectors)))
    kept = F.when(F.size("__raw") > 0, bound(chunked(F.col("__clean")), lambda c: resolve.resolved(F.col("__raw"), c, overlap))).otherwise(F.array().cast(SPANS))
    # a row that comes out of a generator: conditions on spans, which later steps imply too, stay above it, so that nothing is searched twice
    return got.select(*names, F.explode(F.array(resolve.wanted(kept, entities, min_score))).alias("spans"))
