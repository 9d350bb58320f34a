"""Listings of one article from different sellers: seller-constrained assignment.

1. A listing is read into properties: kind, quantities in common units, colours and the like by meaning, its article
   number, and the words that may name the series. Wording, order and marketing words fall away. Rare spellings of
   series words are corrected towards frequent ones.
2. Listings are blocked by their series word, and by their article number. Listings of one reading collapse to a form,
   so a frequent article or seller costs no more than a rare one.
3. Forms of a block that contradict each other in no property are scored by the share of properties they tell
   alike; one article number scores 1. Connected components of these pairs are solved apart.
4. In a component, a maximum-weight matching is solved for each pair of sellers with different offers (the forms a
   seller lists). Matches are merged in the order of their weight unless a cycle would join contradicting readings.
   What is left, of the same seller too, joins the only class it is compatible with.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sheafwork.llm.strings import distance, fold
from sheafwork.session import written

LIKE = 0.5  #: share of told properties from which two forms may be one article
IN_CALL = 5000  #: forms solved in one call of Python, about; a component is never divided
MISSING = 2  #: properties that the shorter of two forms may leave out
TYPO_RATIO = 4  #: a spelling is a typing error of a neighbour at least this many times as frequent
# Words of colours, materials and other properties, by the value they mean.
COLOUR = {"black": "black blk noir schwarz", "white": "white wht blanc weiss", "red": "red rouge rot", "blue": "blue blu bleu blau", "green": "green grn vert grun", "yellow": "yellow yel jaune gelb", "grey": "grey gray gris grau", "cyan": "cyan cyn", "magenta": "magenta mag"}
MATERIAL = {"brass": "brass laiton", "steel": "stainless inox ss", "zinc": "zinc galvanised galvanized galv", "alu": "aluminium aluminum alu", "nylon": "nylon", "copper": "copper cuivre"}
COVER = {"mesh": "mesh", "leather": "leather pu", "fabric": "fabric cloth"}
FINISH = {"matt": "matt mat", "satin": "satin silk", "gloss": "gloss glossy"}
LAYOUT = {"qwerty": "qwerty uk", "azerty": "azerty fr", "qwertz": "qwertz de"}
LINK = {"wired": "wired usb", "wireless": "wireless wless cordless"}
CUT = {"cobalt": "cobalt hss-co", "hss": "hss high speed", "carbide": "carbide carb"}
ADJUST = {"ratchet": "ratchet", "slip": "slip"}
BUS = {"sata": "sata", "nvme": "nvme"}
INK = {"mono": "mono monochrome b/w", "colour": "colour color 4-colour"}
FRAME = {"tower": "tower twr", "rack": "rack rackmount"}
FORM = {"gel": "gel", "foam": "foam", "spray": "spray"}
SCREEN = {"fhd": "fhd 1080p full", "qhd": "qhd 1440p", "uhd": "uhd 4k 2160p"}
# Kinds of article: code, words that name it, and its properties.
KINDS = {
    "sy": ("syringe", "ml pack"), "hb": ("bolt", "thread length material"), "pc": ("patch network rj45", "cat length colour"), "el": ("extension", "ways length"), "cp": ("paper", "sheet gsm sheets"),
    "kb": ("keyboard kbd", "layout link colour"), "pt": ("paint", "ml finish colour"), "oc": ("chair", "cover colour"), "sv": ("shelving shelf storage", "levels length colour"), "br": ("bracket l-bracket", "length material"),
    "ng": ("gloves", "size pack"), "ho": ("hose", "bore length colour"), "mo": ("monitor display screen", "inch screen"), "hs": ("sanitiser sanitizer sanitising sanitizing", "ml form"), "tc": ("toner", "colour pages"),
    "db": ("drill", "dia cut"), "sm": ("sfp transceiver module", "mbps length"), "ms": ("switch", "ports mbps"), "sh": ("helmet hat", "adjust colour"), "bt": ("battery", "mah volt"), "wp": ("pump", "watt volt"),
    "sd": ("ssd flash solid", "gb bus"), "ld": ("led panel", "watt kelvin"), "lp": ("laser printer", "ppm ink"), "up": ("ups uninterruptible", "va frame"),
}
_WORDS = {"colour": COLOUR, "material": MATERIAL, "cover": COVER, "finish": FINISH, "layout": LAYOUT, "link": LINK, "cut": CUT, "adjust": ADJUST, "bus": BUS, "ink": INK, "frame": FRAME, "form": FORM, "screen": SCREEN}
# Further words of the articles, of marketing and of the conditions, none of them a series.
COMMON = set(
    """disposable luer hexagon hex head cord cable lead power copy copier printer computer emulsion interior wall office desk task swivel back steel rack unit angle mounting l-bracket exam nitrile garden water reinforced
    lcd desktop hand bottle cartridge laser twist bit optical module managed l2 safety hard adj sealed rechargeable pack for centrifugal drive state internal panel ceiling light backup supply plated size sz din a3 a4 a5 mm cm
    m mtr metre meter km ml cc l ltr litre in inch of box pk dia bore port ports way sockets tier levels shelves pages pg yield ppm watt w kw kva va v volt volts ah mah gb tb g mbps k kelvin gsm sheets sh ream hd mount
    layout stainless zinc m.2 2.5in price per rate hundred ten thousand pcs prix pour pro stuck total thousands milliers quoted amounts figures all line en x1000 in k usd eur gbp mur zar inr aed euros euro dollars us pounds
    sterling rand mauritian indian rupees rupee uae dirhams cents cent ct c pence paise fils lakh eurocent gbx premium quality best seller special offer latest model heavy duty value line top grade free delivery stock
    limited original genuine eco new neuf hot promo clearance trade yr warranty and with a the""".split()
)
_MARK = re.compile(
    r"\(price in [^)]*\)|\[all figures [^\]]*\]|[,-]?\s*(?:quoted in|amounts in)\s.*$|/\s*prix en\s.*$|[\[(]?(?:line )?total (?:en milliers|in thousands|in k|x\s?1000|'000)[\])]?"
    r"|-?\s*(?:price|rate|prix) (?:per|pour) (?:10+|ten|hundred|thousand)\b|\bpro 10+ st.ck|\(?(?:per |/\s?)10+ pcs\)?|\*\*hot\*\*|\(promo\)|\b\d yr warranty\b|\b(?:special offer|free delivery|best seller|trade price|value line|latest model|top grade|heavy duty|premium quality|in stock)\b"
)
MPN = re.compile(r"(?<![a-z])(?=([a-z]{5})([-/ ]?)([0-9a-z]{5,7})(?![0-9a-z]))")  # candidates may overlap, so nothing is consumed
_NUM = r"(\d+(?:[.,]\d+)?)\s*-?\s*"


def _num(x: str, factor: float = 1.0) -> str:
    return f"{round(float(x.replace(',', '.')) * factor, 3):g}"


@lru_cache(50_000)
def _vocabulary(kind: str) -> dict[str, tuple[str, str]]:
    out = {}
    for name in KINDS[kind][1].split() if kind else _EVERY:
        for value, words in _WORDS.get(name, {}).items():
            for w in words.split():
                out[w] = (name, value)
    return out


_KIND_WORD = {w: k for k, (words, _) in KINDS.items() for w in words.split()}
_LONG_KIND = [w for w in _KIND_WORD if len(w) >= 5]
_ALL_WORDS = COMMON | set(_KIND_WORD) | {w for d in _WORDS.values() for ws in d.values() for w in ws.split()}
_LONG_WORDS: dict[int, list[str]] = defaultdict(list)
for _w in sorted(_ALL_WORDS):
    if len(_w) >= 4:
        _LONG_WORDS[len(_w)].append(_w)


@lru_cache(50_000)
def _known(word: str) -> str:
    """The common word meant by `word`, one typing error allowed in a long word; '' if none."""
    if word in _ALL_WORDS:
        return word
    if len(word) >= 5:
        for n in (len(word), len(word) - 1, len(word) + 1):
            for w in _LONG_WORDS.get(n, ()):
                if distance(word, w) == 1:
                    return w
    return ""


@lru_cache(50_000)
def _near_kind(word: str) -> tuple[str, ...]:
    """Kinds with a naming word one typing error away from a short word."""
    return tuple(sorted({k for w, k in _KIND_WORD.items() if len(w) >= 3 and distance(word, w) == 1}))


def _kind(words: list[str]) -> str:
    """Kind by the words; the laser in a toner or a switch's power decides nothing."""
    votes = [_KIND_WORD[w] for w in words if w in _KIND_WORD] + [k for w in words if w not in _ALL_WORDS and len(w) in (3, 4, 5) for k in _near_kind(w)]
    for k in ("tc", "cp", "bt", "up", "ms"):
        if k in votes:
            return k
    if "sm" in votes:
        return "sm"
    return max(sorted(set(votes)), key=votes.count) if votes else ""


_EVERY = sorted({p for _, ps in KINDS.values() for p in ps.split()} - {"inch", "dia", "thread"})  #: what an article of no known kind may tell; a length is a length there


def _quantities(kind: str, text: str) -> dict[str, str]:
    """Measured properties of a kind, or of any where it is unknown, in common units, from folded text."""
    want, out = KINDS[kind][1].split() if kind else _EVERY, {}

    def take(name: str, pattern: str, convert) -> None:
        if name in want and name not in out and (m := re.search(pattern, text)):
            out[name] = convert(m)

    take("bore", r"(1/2|3/4)|(\d+) ?mm bore", lambda m: {"1/2": "13", "3/4": "19"}.get(m[1]) or m[2])
    if "bore" in want:
        text = re.sub(r"\d+ ?mm bore|\d/\d ?(?:in\b|inch\b|\"|'')?", " ", text)
    take("ml", _NUM + r"(ml|cc|ltr|litres?|liters?|l)\b", lambda m: _num(m[1], 1 if m[2] in ("ml", "cc") else 1000))
    take("length", _NUM + r"(mm|cm|km|m|mtr|metres?|meters?)\b", lambda m: _num(m[1], {"mm": 1, "cm": 10, "km": 1e6}.get(m[2], 1000)))
    take("pack", r"\b(?:pack of|box of|pk) ?(\d+)|\b(\d+) ?- ?pack\b|\b(\d+) in a box|\b(\d+) ?pk\b", lambda m: next(g for g in m.groups() if g))
    take("thread", r"\bm ?(\d+)\b(?!\s*(?:m|cm|mm)\b)", lambda m: m[1])
    take("cat", r"\bcat\.? ?(5e|6a|6|7)\b", lambda m: m[1])
    take("ways", _NUM + r"(?:ways?|sockets?|gang)\b", lambda m: _num(m[1]))
    take("sheet", r"\b(a[2-6])\b", lambda m: m[1])
    take("gsm", _NUM + r"(?:gsm|g/m2|g/m)", lambda m: _num(m[1]))
    take("sheets", r"\b(\d+) ?(?:sheets?|sh)\b|\bream (?:of )?(\d+)", lambda m: m[1] or m[2])
    take("levels", _NUM + r"(?:tiers?|levels?|shelves|shelf)\b", lambda m: _num(m[1]))
    take("size", r"(?:\(|\bsize |\bsz )(xxl|xl|s|m|l)\b", lambda m: m[1])
    take("inch", r"\b(\d{2})(?: ?in\b| ?inch\b| ?\"|'')|\b(\d{2}) ?cm\b", lambda m: m[1] or f"{float(m[2]) / 2.54:.0f}")
    take("pages", r"\byield (\d+)|\b(\d+) ?(?:pages?|pg)\b(?!/)", lambda m: m[1] or m[2])
    take("dia", r"o ?(\d+(?:\.\d+)?) ?mm|" + _NUM + r"mm(?: dia)?\b", lambda m: _num(m[1] or m[2]))
    take("mbps", _NUM + r"(mbps|mbit/s|gbps|gbit/s|g)\b", lambda m: _num(m[1], 1 if m[2].startswith("m") else 1000))
    take("ports", r"\b(\d+) ?-? ?(?:ports?|p)\b", lambda m: m[1])
    take("mah", _NUM + r"(mah|ah)\b", lambda m: _num(m[1], 1 if m[2] == "mah" else 1000))
    take("volt", _NUM + r"(?:v|volts?)\b", lambda m: _num(m[1]))
    take("watt", _NUM + r"(kw|w|watts?)\b", lambda m: _num(m[1], 1000 if m[2] == "kw" else 1))
    take("kelvin", _NUM + r"(?:k|kelvin)\b", lambda m: _num(m[1]))
    take("gb", _NUM + r"(gb|tb)\b", lambda m: _num(m[1], 1000 if m[2] == "tb" else 1))
    take("ppm", _NUM + r"(?:ppm|pages/min|p/min)", lambda m: _num(m[1]))
    take("va", _NUM + r"(kva|va)\b", lambda m: _num(m[1], 1000 if m[2] == "kva" else 1))
    return out


def _numbers(text: str) -> list[tuple[int, str, tuple[int, int]]]:
    """Rank, number and place of what may be an article number: five letters and a counter of five to seven places, neither an ordinary word.

    A counter that begins with 0 is one in any notation (3), one with a digit after a hyphen or stroke too (2); other
    notations (1) and counters of letters alone (0) may be words and sizes.
    """
    out = []
    for m in MPN.finditer(text):
        head, sep, tail = m.groups()
        if tail[0] == "0" and len(tail) == 5:
            rank = 3
        elif head in _ALL_WORDS or tail in _ALL_WORDS or (tail.isalpha() and _known(tail)):
            continue
        else:
            rank = 0 if tail.isalpha() else 2 if sep in ("-", "/") else 1
        out.append((rank, head + tail, (m.start(), m.end(3))))
    return out


def parse_listing(description: str | None, ref: str | None) -> dict:
    """number (article number), kind, values (name=value, sorted), rest (words that may name the series, folded), maybe (a number if another listing's ref has it)."""
    text = fold(description or "")
    given, said = _numbers(fold(ref or "").replace(":", " ")), _numbers(text)
    sure = [x for x in said if x[0] >= 2]
    number = max(given or sure, key=lambda x: x[0], default=(0, ""))[1]
    maybe = next((n for r, n, (a, b) in said if not r and re.search("[-/]", text[a:b])), "") if not number else ""
    for _, _, (a, b) in reversed(sure):
        text = f"{text[:a]} {text[b:]}"
    text = _MARK.sub(" ", text)
    words = re.findall(r"[a-z][a-z0-9./-]*[a-z0-9]|[a-z]|4k\b|4-colour|1080p|1440p|2160p", text)
    known = [(w, _known(w.rstrip("."))) for w in words]
    kind = _kind([k or w for w, k in known])
    rest = sorted({w for w, k in known if not k and len(w) >= 3 and w.isalpha()})
    values = _quantities(kind, text)
    vocabulary = _vocabulary(kind)
    said = [(w, w if w in vocabulary else _known(w)) for w in re.findall(r"4-colour|b/w|[a-z0-9][a-z0-9-]*", text)]
    if kind == "hs":  # "sanitizer gel" and "sanitising gel" name the kind, "foam" and "spray" tell the form before "gel"
        said = [x for i, x in enumerate(said) if not (x[1] == "gel" and i and said[i - 1][1] in ("sanitizer", "sanitizing", "sanitising"))]
        said.sort(key=lambda x: x[1] == "gel")
    for _, w in said:
        if w in vocabulary and vocabulary[w][0] not in values:
            values[vocabulary[w][0]] = vocabulary[w][1]
    return {"number": number, "kind": kind, "values": sorted(f"{k}={v}" for k, v in values.items()), "rest": rest, "maybe": maybe}


_PARSED = StructType([StructField("number", StringType()), StructField("kind", StringType()), StructField("values", ArrayType(StringType())), StructField("rest", ArrayType(StringType())), StructField("maybe", StringType())])


@F.pandas_udf(_PARSED)
def _parse(descriptions: pd.Series, refs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_listing(d, r) for d, r in zip(descriptions, refs)], columns=[f.name for f in _PARSED])


def _deletions(word):
    """The word and the word with each letter left out, in the JVM."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def correct_words(words: DataFrame, ratio: int = TYPO_RATIO) -> DataFrame:
    """word, n (rows), right (the frequent spelling meant, or the word itself), of a frame with one column `word`.

    A word is an error of another one edit away (a swap counts once) that is at least `ratio` times as
    frequent; the most frequent such word is meant. Candidates share a deletion of one letter.
    """
    freq = words.groupBy("word").agg(F.count("*").alias("n"))
    keys = written(freq.withColumn("cut", F.explode(_deletions(F.col("word")))), "cuts")
    other = keys.select(F.col("word").alias("right"), F.col("n").alias("m"), "cut").where("m >= 3")
    near = keys.join(other, "cut").where((F.col("m") >= F.col("n") * ratio) & (F.col("word") != F.col("right"))).select("word", "right", "m").distinct()
    swapped = (F.length("word") == F.length("right")) & (F.levenshtein("word", "right") == 2) & (F.array_sort(F.split("word", "")) == F.array_sort(F.split("right", "")))
    best = near.where((F.levenshtein("word", "right") == 1) | swapped).groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"), F.max("m").alias("m"))
    return freq.join(best, "word", "left").select("word", F.coalesce("m", "n").alias("n"), F.coalesce("right", "word").alias("right"))


def _read(items: DataFrame, makers: DataFrame) -> DataFrame:
    """item_id, seller, series (the block), values (with the kind), number. The series of an article number is the one most of its listings give."""
    parsed = written(items.withColumn("p", _parse("description", "ref")).select("item_id", "seller", "p.*"), "read")
    told = parsed.where("number <> ''").select(F.col("number").alias("maybe"), F.col("number").alias("sure")).distinct()
    doubtful = parsed.where("maybe <> ''").join(told, "maybe", "left").withColumn("number", F.coalesce("sure", "number")).drop("sure")
    parsed = parsed.where("maybe = ''").unionByName(doubtful).drop("maybe")
    words = parsed.select("item_id", F.explode("rest").alias("word"))
    makers = makers.select(F.lower("name").alias("right")).distinct()
    right = written(correct_words(words.select("word")).join(makers, "right", "left_anti"), "right")
    series = words.join(right, "word").groupBy("item_id").agg(F.max_by("right", F.struct((F.length("right") >= 4).alias("long"), "n", "right")).alias("series"))
    rows = parsed.drop("rest").join(series, "item_id", "left")
    named = rows.where("number <> '' and series is not null").groupBy("number", "series").agg(F.count("*").alias("c")).groupBy("number").agg(F.max_by("series", F.struct("c", "series")).alias("its"))
    rows = rows.join(named, "number", "left")
    kind = F.when(F.col("kind") != "", F.array(F.concat(F.lit("kind="), "kind"))).otherwise(F.array().cast("array<string>"))
    block = F.coalesce("its", "series", F.when(F.col("number") != "", F.col("number")))
    return rows.select("item_id", F.coalesce("seller", F.lit("")).alias("seller"), block.alias("series"), F.concat(kind, "values").alias("values"), "number").where("series is not null")


def _assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight matching of rows to columns (Hungarian method with potentials); pairs of weight 0 are left out."""
    rows, cols = weight.shape
    if rows > cols:
        return [(i, j) for j, i in _assignment(weight.T)]
    cost = weight.max(initial=0.0) - weight
    u, v, match, way = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int), np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        match[0], j0, least, used = i, 0, np.full(cols + 1, np.inf), np.zeros(cols + 1, bool)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, cols + 1) if match[j] and weight[match[j] - 1, j - 1] > 0]


Form = tuple[dict[str, str], set[str]]  #: properties and article numbers


def _clash(a: Form, b: Form) -> bool:
    """Whether two forms tell a property or the article number differently; one number settles it."""
    if a[1] & b[1]:
        return False
    return any(b[0].get(k, v) != v for k, v in a[0].items()) or bool(a[1] and b[1])


def _score(a: Form, b: Form) -> float:
    """Share of the told properties that two forms tell alike; 1 for one article number, 0 on any contradiction or without a property beside the kind."""
    if a[1] & b[1]:
        return 1.0
    if _clash(a, b):
        return 0.0
    same = a[0].keys() & b[0].keys()
    share = len(same) / len(a[0].keys() | b[0].keys()) if same - {"kind"} else 0.0
    return share if share >= LIKE else 0.0


def _pairings(forms: dict[str, Form], offers: list[tuple[str, ...]]) -> dict[tuple[str, str], float]:
    """Matches of different forms over all pairs of sellers, each by maximum weight within its connected components.

    Forms that both sellers have are matched with each other. Sellers with one offer give the same matches,
    so each pair of offers is solved once.
    """
    out: dict[tuple[str, str], float] = {}
    for n, a in enumerate(offers):
        for b in offers[:n]:
            left, right = [f for f in a if f not in b], [f for f in b if f not in a]
            edges = {(x, y): w for x in left for y in right if (w := _score(forms[x], forms[y])) > 0}
            group: dict[str, str] = {f: f for f in left + right}
            for x, y in edges:
                old, now = group[y], group[x]
                group.update({f: now for f, g in group.items() if g == old})
            for g in sorted({group[x] for x, _ in edges}):
                mine, theirs = [f for f in left if group[f] == g], [f for f in right if group[f] == g]
                weight = np.array([[edges.get((x, y), 0.0) for y in theirs] for x in mine])
                for i, j in _assignment(weight):
                    out[min(mine[i], theirs[j]), max(mine[i], theirs[j])] = weight[i, j]
    return out


def _component(offered: list) -> list[tuple[str, str, str]]:
    """(form, article, how) of one component, from its different offers: how a form came to its article (matching, fitting, alone).

    A form with equally good partners that contradict each other, of any seller, joins by its article number only.
    """
    forms: dict[str, Form] = {}
    offers = []
    for offer in offered:
        offers.append(tuple(sorted(f["form"] for f in offer)))
        for f in offer:
            forms[f["form"]] = (dict(v.split("=", 1) for v in f["values"]), {f["number"]} if f["number"] else set())
    scores = {x: {y: w for y in forms if y != x and (w := _score(forms[x], forms[y])) > 0} for x in forms}
    torn = set()
    for x, partners in scores.items():
        guessed = {y: w for y, w in partners.items() if not forms[x][1] & forms[y][1]}  # a common article number is no guess
        best = [y for y, w in guessed.items() if w == max(guessed.values())]
        if any(_clash(forms[y], forms[z]) for i, y in enumerate(best) for z in best[:i]):
            torn.add(x)
    home = {f: f for f in forms}
    joined = {f: (dict(v), set(n)) for f, (v, n) in forms.items()}
    how = dict.fromkeys(forms, "alone")

    def merge(x: str, y: str, way: str) -> None:
        a, b = home[x], home[y]
        if a != b and not _clash(joined[a], joined[b]):
            into, gone = sorted((a, b), key=lambda f: (-len(joined[f][0]), f))
            joined[into] = (joined[gone][0] | joined[into][0], joined[into][1] | joined.pop(gone)[1])
            home.update({f: into for f, h in home.items() if h == gone})
            how.update({f: way for f in (x, y) if how[f] == "alone"})

    for (x, y), _ in sorted(_pairings(forms, sorted(set(offers))).items(), key=lambda m: (-m[1], m[0])):
        if (x not in torn and y not in torn) or forms[x][1] & forms[y][1]:
            merge(x, y, "matching")  # values that contradict what is merged so far close a contradicting cycle
    hub: dict[str, str] = {}
    for x in sorted(forms):
        for n in forms[x][1]:
            merge(x, hub.setdefault(n, x), "fitting")
    size = Counter(home.values())
    alone = sorted(x for x in forms if x not in torn and size[home[x]] == 1)
    fits = {x: [c for c in sorted(joined) if c != x and c not in torn and _score(forms[x], joined[c]) > 0] for x in alone}
    for x, classes in fits.items():
        if len(classes) == 1:
            merge(x, classes[0], "fitting")
    return [(f, home[f], how[f]) for f in forms]


def _solved(rows: pd.DataFrame) -> pd.DataFrame:
    """Many components in one call, as a call costs more than a component."""
    by: dict[str, list] = defaultdict(list)
    for component, offer in zip(rows["component"], rows["offer"]):
        by[component].append(offer)
    return pd.DataFrame([r for offered in by.values() for r in _component(offered)], columns=["form", "article", "how"])


def _without(values: Column, n: int) -> Column:
    """The sets of `values` with 0 to n (at most 2) elements left out."""
    one = F.transform(values, lambda v: F.array_remove(values, v))
    sets = [F.array(values), one] + ([F.flatten(F.transform(one, lambda s: F.transform(s, lambda v: F.array_remove(s, v))))] if n > 1 else [])
    return F.array_distinct(F.concat(*sets))


def _edges(forms: DataFrame) -> DataFrame:
    """a, b: forms of one block that may be one article, in both directions.

    A form meets those whose properties hold all of its own (all but one of them, where some must be missing),
    by a join on the set; forms of one article number meet its first form. So no group is paired with itself.
    """
    key = lambda s: F.xxhash64("series", F.array_join(s, "\u0001"))
    small = F.size("values") >= 2
    side = lambda x: [F.col("form").alias(x), F.col("values").alias(f"v{x}"), F.col("number").alias(f"n{x}")]
    mine = F.when(F.col("short"), _without(F.col("values"), 1)).otherwise(F.array("values"))
    left = forms.where(small).select(*side("a"), F.explode(F.array_distinct(F.transform(mine, key))).alias("key"))
    right = forms.where(small).select(*side("b"), F.explode(F.array_distinct(F.transform(F.filter(_without(F.col("values"), MISSING), lambda s: F.size(s) >= 2), key))).alias("key"))
    names = lambda v: F.transform(v, lambda x: F.substring_index(x, "=", 1))
    same, told = F.size(F.array_intersect("va", "vb")), F.size(F.array_intersect(names("va"), names("vb")))
    fits = (same == told) & (same >= LIKE * (F.size("va") + F.size("vb") - same)) & ((F.col("na") == "") | (F.col("nb") == "") | (F.col("na") == F.col("nb")))
    alike = left.join(right, "key").where(F.col("a") != F.col("b")).where(fits).select("a", "b")
    numbered = forms.where("number <> ''").select("form", "number")
    hub = numbered.groupBy("number").agg(F.min("form").alias("hub"))
    star = numbered.join(hub, "number").where("form <> hub").select(F.col("form").alias("a"), F.col("hub").alias("b"))
    one = alike.unionByName(star)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _components(edges: DataFrame) -> DataFrame:
    """form, component (the smallest form reached), by passing the smallest name on until nothing changes; every round is a written table."""
    labels = written(edges.groupBy(F.col("a").alias("form")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("form").alias("b"), "component"), "b").groupBy(F.col("a").alias("form")).agg(F.min("component").alias("near"))
        further = labels.join(labels.select(F.col("form").alias("component"), F.col("component").alias("far")), "component")
        after = further.join(seen, "form").select("form", F.least("component", "near", "far").alias("now"), "component")
        after = written(after, "labels")
        labels = after.select("form", F.col("now").alias("component"))
        if after.where("now <> component").isEmpty():
            return labels


def match_listings(items: DataFrame, makers: DataFrame) -> DataFrame:
    """item_id, article, how (equal, matching, fitting, alone): listings with one article are the same product.

    `items` has item_id, seller, description, ref, one row per item; `makers` has name. Listings without a word
    that may name a series and without an article number get no row; those that tell no property stay alone
    unless their number is known. `how` says what joined the listing's reading to others: nothing but equal readings,
    a match of seller pairs, or being the only fit. An empty frame gives an empty result.
    """
    need = F.create_map(*[F.lit(x) for k, (_, ps) in KINDS.items() for x in (f"kind={k}", len(ps.split()) + 1)])
    told = F.size("values") > F.when(F.get("values", F.lit(0)).startswith("kind="), 1).otherwise(0)
    read = _read(items, makers).withColumn("short", F.size("values") < F.coalesce(need[F.get("values", F.lit(0))], F.lit(99)))
    form = F.concat_ws("|", "series", F.array_join("values", ","), "number", F.when(~told & (F.col("number") == ""), F.col("item_id")))
    rows = written(read.withColumn("form", form), "listings")
    forms = written(rows.groupBy("form").agg(*[F.first(c).alias(c) for c in ("series", "values", "number", "short")], F.count("*").alias("n")), "forms")
    edges = written(_edges(forms), "edges")
    parts = _components(edges)
    inside = rows.join(parts, "form").groupBy("component", "seller").agg(F.array_sort(F.collect_set(F.struct("form", "values", "number"))).alias("offer"))
    calls = max(1, parts.count() // IN_CALL)
    offers = inside.select("component", "offer").distinct()
    solved = offers.groupBy(F.pmod(F.xxhash64("component"), F.lit(calls)).alias("call")).applyInPandas(_solved, "form string, article string, how string")
    found = rows.select("item_id", "form").join(solved, "form", "left").join(forms.select("form", "n"), "form")
    return found.select("item_id", F.coalesce("article", "form").alias("article"), F.coalesce("how", F.when(F.col("n") > 1, "equal").otherwise("alone")).alias("how"))
