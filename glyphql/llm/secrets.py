"""Secret scans: three base patterns, and two character Markov models compared by log-likelihood ratio.

All of it is DataFrame functions. A pattern's matches come from one pass, the gaps between them from a second one where it
has any; offsets are their running sums, in code points, taken block by block so that many matches cost no more each than
few. Every token of ``LEAST_VALUE`` characters and more outside the base patterns is scored by two first-order models of
characters, one of random strings and one of ordinary identifiers; it is a secret if the models' log-likelihood ratio
reaches ``LEAST_RATIO``: the ratio alone decides.

The models are trained from labelled samples. Random: what the base patterns find in the documents, and generated strings
over the usual alphabets of keys. Ordinary: the documents' words, alone and joined to identifiers (snake, kebab, camel and
upper case, paths, numbered names), identifiers of usual words, and generated dates, versions, numbers and ruled lines. The documents' part is fitted on
about ``SAMPLE_DOCS`` documents, chosen by a hash of the id; every document is scanned.

Defined results: null and empty texts have no spans; matches that fail a base pattern's length are dropped after matching,
so they still consume their text; spans of one kind never overlap, those of different base kinds may; repeated rows are
scanned each for itself; an empty table gives an empty result, and models of the generated samples alone; other columns are
neither read nor returned by :func:`scan`, and all pass through :func:`redact`.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base patterns, and the least length of what they find.
KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?""" + f"({VALUE}+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: The models' characters; all others share the place 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_VALUE},}}"
WORD = "(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,24}(?![A-Za-z0-9+/_=-])"
#: A token that holds a match of a base pattern overlaps that span.
HOLDS_BASE = "[0-9a-f]{16}|AKIA[A-Z0-9]{14}"
LEAST_RATIO = 12.0
#: The weight of single characters against pairs, in pairs.
BACK_OFF = 20.0
SAMPLE_DOCS = 2000
#: So many pairs of characters of the documents weigh half as much as they can.
FEW_PAIRS = 20_000
BLOCK = 256
#: Ordinary words of identifiers, paths and names, for what the documents' own vocabulary lacks.
IDENTIFIER_WORDS = """
account action address admin agent analysis application archive array author backup binary board branch browser buffer build button cache
calendar category certificate change channel chapter character checkpoint client cluster code collection column command comment company
component config connection container content context control counter country course create customer data database date default delete
description design desktop detail device directory display document domain download driver dynamic editor element email engine entry error
event example exception execute export extension factory feature field file filter final folder format framework function gateway global
graph group handler hash header height hello history home host html identifier image import index information input install instance
integer interface internal item java javascript journal json kernel key label language layout length level library license linux list local
location logger machine main manager market matrix maximum measure member memory message method minimum mobile model module monitor
network node number object office online operation option order output package page parameter parent password path pattern person picture
platform plugin point policy position print private process product profile program project property protocol public python query queue
random range record reference region register release report request resource response result return route runtime sample schedule schema
school science script search section select sequence server service session setting shadow share signal simple site size socket software
source stack standard state static station status storage stream string structure student style summary support switch system table target
task template terminal test thread time title total transaction transfer tree trigger type unit update upload user utility value variable
vector version video view virtual volume warning website weight widget window work world wrapper write year straße haus schiff fahrt
gesellschaft wissenschaft entwicklung verwaltung bibliothèque développement informations universidad desarrollo biblioteca
""".split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for several uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _placed(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, value) of all matches in order; value: the matched text."""
    none, no_ints = F.expr(f"cast(array() as {_SPANS})"), F.expr("cast(array() as array<int>)")

    def within(block: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["to"] + x["gap"]
            end = start + x["len"]
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("to"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(block, F.struct(base.alias("to"), none.alias("spans")), step, lambda acc: acc["spans"])

    def bases(blocks: Column) -> Column:
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        step = lambda acc, n: F.struct((acc["to"] + n).alias("to"), F.concat(acc["at"], F.array(acc["to"])).alias("at"))
        return F.aggregate(total, F.struct(F.lit(0).alias("to"), no_ints.alias("at")), step, lambda acc: acc["at"])

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("value")))
        cut = lambda p: F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(pieces, lambda p: _let(cut(p), lambda blocks: F.flatten(F.zip_with(blocks, bases(blocks), within))))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))


def with_base(docs: DataFrame, text: Column, into: str = "_base") -> DataFrame:
    """Adds the spans of the base patterns, one array of each kind."""
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 1)
    none = F.expr(f"cast(array() as {_SPANS})")
    assign = F.transform(_placed(text, ASSIGN, 0), lambda x: x.withField("value", value(x)))
    return docs.withColumns({
        f"{into}0": F.filter(assign, lambda x: F.length(x["value"]) >= LEAST_VALUE),
        f"{into}1": F.when(F.contains(text, F.lit("AKIA")), _placed(text, ACCESS, 1)).otherwise(none),
        f"{into}2": _placed(text, HEX, 2),
    })


def random_samples() -> list[str]:
    """Generated keys over the usual alphabets."""
    rng = random.Random(11)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = (digits + "abcdef", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-", lower, lower + upper)
    return ["".join(rng.choice(a) for _ in range(32)) for a in alphabets for _ in range(400)]


def ordinary_samples() -> list[str]:
    """Identifiers of usual words, generated dates, versions and numbers."""
    rng = random.Random(12)
    n = lambda digits: str(rng.randrange(10 ** (digits - 1), 10**digits))
    words = [w for w in IDENTIFIER_WORDS if w.isascii()]
    out = []
    for w in words:
        v = rng.choice(words)
        out += [w, f"{w}/{v}", f"{w}_{v}", f"{w}-{v}", f"{w}{v.title()}", f"{w.title()}{v.title()}", f"{w.upper()}_{v.upper()}", f"{w}.{v}", f"{w}{rng.randint(1, 999)}", f"{w}{v}"] * 3
    for _ in range(1500):
        y, m, d, h = rng.randint(1900, 2100), rng.randint(1, 12), rng.randint(1, 31), rng.randint(0, 23)
        out += [f"{y}-{m:02}-{d:02}", f"{y}/{m:02}/{d:02}", f"{y}-{m:02}-{d:02}T{h:02}-{d:02}-{m:02}", f"{y}{m:02}{d:02}", f"v{m}.{d}.{h}", f"{m}.{d}.{h}-rc{m}", n(rng.randint(1, 16)), f"+{n(2)}-{n(3)}-{n(7)}"]
    return out


def _joined_words(word: Column) -> Column:
    """A word as it is and as part of identifiers."""
    title, upper, lower = F.initcap(word), F.upper(word), F.lower(word)
    shapes = [word, F.concat(lower, F.lit("_"), lower), F.concat(lower, F.lit("-"), lower), F.concat(lower, F.lit("/"), lower), F.concat(lower, title, title), F.concat(upper, F.lit("_"), upper), F.concat(lower, F.lit("."), lower)]
    return F.array(*shapes, *(F.concat(lower, F.lit(x)) for x in ("1", "_20", "-2/", "=")), F.concat(F.lit("7-"), lower), F.concat(F.lit("0_"), lower))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each pair of adjacent characters: ``ratio[before * n + after]``."""
    n = len(ALPHABET) + 1
    share = sample_docs / max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < int(share * (1 << 32))) if share < 1 else docs
    text = F.col("_text")
    rows = with_base(chosen.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")), text)
    found = rows.select(F.explode(F.transform(F.concat("_base0", "_base1", "_base2"), lambda x: x["value"])).alias("token")).groupBy("token").count()
    words = rows.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").count()
    tokens = found.select(F.lit(1).alias("label"), "token", "count").unionAll(
        words.select(F.lit(0).alias("label"), F.explode(_joined_words(F.col("word"))).alias("token"), "count")
    ).where(F.length("token") > 1)
    # Longer values than a key ever is would outweigh all others, and a character's place costs more the farther it lies.
    ends = F.sequence(F.lit(1), F.least(F.length("token"), F.lit(1024)) - 1)
    pairs = tokens.select("label", "count", F.explode(F.transform(ends, lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    seen = [Counter(), Counter()]
    for r in pairs.groupBy("label", "pair").agg(F.sum("count").alias("times")).collect():  # pairs of characters, at most two for each pair of the alphabet
        seen[r["label"]][r["pair"]] += r["times"]
    return ratios_of(*seen)


def ratios_of(ordinary: Counter, found: Counter) -> list[float]:
    """The models of the documents' pairs and the generated samples, as logarithms of the ratios of their probabilities."""
    n = len(ALPHABET) + 1
    place = {c: k + 1 for k, c in enumerate(ALPHABET)}
    counts = [[0.0] * (n * n) for _ in range(2)]

    def add(label: int, pairs: Counter, weight: float = 1.0) -> None:
        for pair, times in pairs.items():
            counts[label][place.get(pair[0], 0) * n + place.get(pair[1], 0)] += times * weight

    def pairs_of(samples: list[str]) -> Counter:
        return Counter(t[k : k + 2] for t in samples for k in range(len(t) - 1))

    made = [pairs_of(ordinary_samples()), pairs_of(random_samples())]
    # However many documents there are, they count for half at most, and for less the fewer pairs they have.
    for label, own in ((0, ordinary), (1, found)):
        total = own.total()
        share = 0.5 * total / (total + FEW_PAIRS)
        add(label, own, share * 1e6 / max(1, total))
        add(label, made[label], (1 - share) * 1e6 / made[label].total())
    for c in ALPHABET:  # ruled lines, where another one is as likely as all else; drawn-out words and numbers
        row = place[c] * n
        counts[0][row + place[c]] += (1.0 if c in "-=_+/." else 0.05) * (1 + sum(counts[0][row : row + n]))
    logs = []
    for c in counts:
        # A pair's probability falls back on that of its second character, so pairs never seen count by what they hold.
        ends = [sum(c[b::n]) + 1 for b in range(n)]
        alone = [x / sum(ends) for x in ends]
        begins = [sum(c[a * n : a * n + n]) for a in range(n)]
        logs.append([math.log((c[k] + BACK_OFF * alone[k % n]) / (begins[k // n] + BACK_OFF)) for k in range(n * n)])
    return [round(x - y, 4) for x, y in zip(logs[1], logs[0], strict=True)]


def _ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token of ASCII characters."""
    n = len(ALPHABET) + 1
    literal = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one literal
    model, places = literal(ratios, "double"), literal([ALPHABET.find(chr(k)) + 1 for k in range(128)], "int")
    # Single bytes are found at once in binary, not in text.
    place = lambda raw, i: F.get(places, F.ascii(F.substring(raw, i, F.lit(1)).cast("string")))

    def total(raw: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            return _let(place(raw, i), lambda p: F.struct((acc["sum"] + F.get(model, acc["at"] * n + p)).alias("sum"), p.alias("at")))

        start = F.struct(F.lit(0.0).alias("sum"), place(raw, F.lit(1)).alias("at"))
        return F.aggregate(F.sequence(F.lit(2), F.octet_length(raw)), start, step, lambda acc: acc["sum"])

    return _let(token.cast("binary"), total)


def with_spans(docs: DataFrame, ratios: list[float], text: Column) -> DataFrame:
    """Adds ``_base0`` to ``_base2`` and ``_markov``: spans of the models outside the base ones."""
    rows = with_base(docs, text)
    # Tokens are sought where no assignment lies: those are blanked, at their length.
    blank = lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 1)) >= LEAST_VALUE, F.repeat(F.lit(" "), F.char_length(m))).otherwise(m)
    matches = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), blank)
    blanked = F.array_join(F.zip_with(F.split(text, ASSIGN, -1), matches, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    rows = rows.withColumn("_rest", F.when(F.size("_base0") > 0, blanked).otherwise(text))
    secret = lambda x: ~x["value"].rlike(HOLDS_BASE) & (_ratio(x["value"], ratios) >= LEAST_RATIO)
    return rows.withColumn("_markov", F.filter(_placed(F.col("_rest"), TOKEN, 3), secret)).drop("_rest")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = F.concat("_base0", "_base1", "_base2")
    return with_spans(rows, ratios, F.col("_text")).select(
        id_col,
        *(F.size(f"_base{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("_markov"))).alias("spans"),
    )


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans by one."""
    rows = with_spans(docs, ratios, F.coalesce(F.col(text_col), F.lit("")))
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["to"], F.concat(F.substring(text, acc["to"] + 1, x["start"] - acc["to"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["kept"], gap).alias("kept"), F.greatest(acc["to"], x["end"]).alias("to"))

    spans = F.array_sort(F.concat("_base0", "_base1", "_base2", "_markov"))
    done = F.aggregate(spans, F.struct(F.lit("").alias("kept"), F.lit(0).alias("to")), step, lambda acc: F.concat(acc["kept"], F.substring(text, acc["to"] + 1, F.char_length(text))))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
