"""Secret scans in DataFrame expressions only.

Three kinds of secrets are found by pattern: assignments to secret-looking names, access keys and
long runs of hex digits. Beyond them, two first-order Markov models of characters, one of random
strings and one of ordinary identifiers, judge every long token by the log-likelihood ratio of its
character pairs: kind `markov`. Both models are trained from labelled samples by a DataFrame
aggregation over character pairs; their ratio is a table of a fixed 66 by 66 numbers. Half of the samples, made of
words and digests that training does not see, choose the threshold: the least that at most FALSE of the ordinary ones reach.

A kind's matches and their places come from one split of the text: the pieces between matches are
cut by the same pattern that lists the matches, so that running lengths give code point positions.

Nulls and edges: a null text is an empty text and has no spans; a null doc_id is kept; repeated rows
give repeated rows; an empty table gives none; columns of other names are never read by `scan`, and
`redact` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: What a text with a match of ASSIGN holds, found in one quick pass.
HINT = r"""(?:[Dd]|[Tt]|[Nn]|[Yy])["']?\x20*[:=]"""
KINDS = ("assign", "access", "hex", "markov")
#: The alphabet of the models; a character outside it ends a token. Position 0 stands for the start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
#: The share of held-out ordinary identifiers that may be called random.
FALSE = 0.001
#: Words that ordinary identifiers, paths and compounds are made of in the labelled samples.
ORDINARY = (
    "account action address array background batch block buffer button cache callback channel client column command config connection container content context controller count create current data date default delete description device directory document element error event factory field file filter format function get group handler header height image index input insert instance item key label language length level line list load location manager map max message method min model module name network node number object offset option order output package page parent parse path pattern point position print process property query queue read record reference region remove request reset resource response result return root row sample save schema screen search select sequence server service session set size source start state status stop store stream string style system table target task template test text thread time timeout title token total transaction type update upload user value version view width window worker write "
    "about after again among answer before between bring called country different during early enough every family father follow government house important interest knowledge large later little measure morning mother national nothing often other people perhaps place possible present problem public question reason school science several should society something still street strong theory thing thought through together toward travel understand various weather whether without woman world young "
    "abend arbeit aufgabe ausbildung bahn bedeutung beispiel bericht bildung bundes deutsch eigentum entwicklung erfahrung erste forschung freiheit freund gemeinschaft geschichte gesellschaft gesetz gesundheit haus jahr kinder kirche leben leistung mensch nacht ordnung rathaus recht regierung schrift schule sprache staat strasse stunde verband verein verfahren versicherung verwaltung wasser welt wirtschaft wissenschaft woche zeitung zukunft "
    "ancien annee apprendre auteur bonheur chambre chemin compte culture depuis droit ecole enfant ensemble environ etude exemple femme gouvernement histoire homme jamais jeunesse jour langue liberte maison matin monde musique nature nouveau ouvrage parole pays pensee peuple politique pouvoir premier quelque raison recherche semaine siecle societe soleil souvenir temps travail ville vivre voyage "
    "agua ahora amigo antes camino ciudad conocimiento corazon cuerpo derecho desarrollo educacion empresa entonces escuela espacio estado familia gobierno grupo guerra hermano historia hombre iglesia juego lengua libro lugar madre manera mayor mercado momento mujer mundo nombre noche nuevo obra padre palabra parte persona poder pueblo salud siempre sistema sociedad tiempo tierra trabajo vida viento"
).split()


def _spread(column: Column, n: int) -> Column:
    """A number below n, by hash."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def samples(spark: SparkSession, held_out: bool, n: int = 3000) -> DataFrame:
    """(text, random): labelled strings of either kind, made by rule: encodings of digests (base64, URL-safe, hex, letters and
    digits, letters alone), and words of ORDINARY joined as identifiers are (camel case, underscores, dashes, paths, plain runs,
    upper case, with numbers), or one character repeated as in ruled lines. The held-out half has other digests and other words."""
    base = spark.range(n if held_out else 0, 2 * n if held_out else n)
    plain = F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "\n\r=", "")
    forms = [plain, F.translate(plain, "+/", "-_"), F.translate(F.lower(plain), "+/", "x7"), F.translate(plain, "0123456789+/", "qXbvKzWjYkPg"), F.sha2(F.concat(F.lit("hex"), F.col("id")), 256)]
    random = base.select(F.explode(F.array(*forms)).alias("text"), F.lit(True).alias("random"))
    words = ORDINARY[held_out::2]
    own = F.array(*(F.get(F.array(*map(F.lit, words)), _spread(F.concat_ws("/", F.col("id"), F.lit(k)), len(words))) for k in range(4)))
    joined = [F.array_join(F.transform(own, F.initcap), ""), *(F.array_join(own, x) for x in ("_", "-", "/", "")), F.upper(F.array_join(own, "_")), F.concat(F.array_join(own, "_"), F.lit("_"), _spread(F.col("id"), 100).cast("string")), F.concat_ws("/", F.get(own, F.lit(0)), F.array_join(own, "-"), F.year(F.date_from_unix_date(_spread(F.col("id"), 20000))).cast("string")), F.repeat(F.substr(F.lit(ALPHABET), _spread(F.col("id"), len(ALPHABET)) + 1, F.lit(1)), F.lit(24))]
    return random.unionByName(base.select(F.explode(F.array(*joined)).alias("text"), F.lit(False).alias("random")))


def ratios(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of each pair of characters, row by row: the first
    index is the left character's number (0: start of the token), the second the right one's."""
    width = len(ALPHABET) + 1
    chars = F.concat(F.array(F.lit(0)), F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c)))
    pairs = labelled.filter("text <> ''").select("random", F.expr("explode(sequence(1, length(text)))").alias("k"), chars.alias("c")).select("random", (F.get("c", F.col("k") - 1) * width + F.get("c", "k")).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # at most 2 * width ** 2 rows
    out = []
    for left in range(width):
        total = [sum(counts.get((kind, left * width + right), 0) for right in range(width)) for kind in (True, False)]
        for right in range(width):
            p = [(counts.get((kind, left * width + right), 0) + 0.5) / (total[i] + 0.5 * width) for i, kind in enumerate((True, False))]
            out.append(round(math.log(p[0] / p[1]), 4))
    return out


def _maybe(text: Column, kind: str, pattern: str) -> Column:
    """Whether the text can have a match, by something cheaper than listing and cutting."""
    if kind == "assign":
        return F.rlike(text, F.lit(HINT))
    return F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(pattern))


_SPANS = "array<struct<start:int,end:int,rank:int>>"


_TRAINED: list[tuple[list[float], float]] = []


def trained(spark: SparkSession) -> tuple[list[float], float]:
    """The ratios of the learned samples and the threshold of the held-out ones, which are the same in every session, made once."""
    if not _TRAINED:
        table = ratios(samples(spark, False))
        reached = samples(spark, True).filter("not random").select(_mean_ratio(F.col("text"), F.lit(table)).alias("x"))
        _TRAINED.append((table, float(reached.agg(F.percentile("x", F.lit(1 - FALSE))).first()[0])))
    return _TRAINED[0]


def _placed(found: Column, between: Column, good: Column, rank: int) -> Column:
    """Spans of the matches whose flag in `good` is set, as (start, end, rank) structs."""
    # zip_with reads its arrays once; an array looked up inside a lambda would be made anew for each match.
    sizes = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    zipped = F.zip_with(sizes, good, lambda x, g: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), g.alias("good")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), F.lit(rank).alias("rank"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["good"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _mean_ratio(token: Column, table: Column) -> Column:
    """A token's mean log-likelihood ratio a character pair."""
    width = len(ALPHABET) + 1
    total = F.aggregate(
        F.split(token, ""),
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(F.instr(F.lit(ALPHABET), c).alias("last"), (acc["sum"] + F.get(table, acc["last"] * width + F.instr(F.lit(ALPHABET), c))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.lit(1), F.length(token))


def spans_of(docs: DataFrame, *, text: str, kept: list[Column], threshold: float | None = None) -> DataFrame:
    """`kept` columns and `spans`: all spans of `text`, by start, then kind. A token is called random above `threshold`, by default that of the held-out samples."""
    table, chosen = trained(docs.sparkSession)
    models, threshold = F.lit(table), chosen if threshold is None else threshold
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = {}
    out = docs.select(*kept, body.alias("__body"))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
    none = F.expr("cast(array() as array<string>)")
    out = out.select("*", *(F.when(_maybe(F.col("__body"), k, p), F.regexp_extract_all("__body", F.lit(p), F.lit(0))).otherwise(none).alias(f"__{k}_m") for k, p in patterns.items()))
    some = lambda k, of: F.when(F.size(f"__{k}_m") > 0, of).otherwise(none)
    out = out.select("*", *(some(k, F.split("__body", p, -1)).alias(f"__{k}_p") for k, p in patterns.items()), F.transform(some("assign", F.regexp_extract_all("__body", F.lit(ASSIGN), F.lit(2))), lambda g: F.length(g) >= 8).alias("__assign_g"))
    always = lambda kind: F.transform(F.col(f"__{kind}_m"), lambda m: F.lit(True))
    goods = {"assign": F.col("__assign_g"), "access": always("access"), "hex": always("hex"), "markov": F.transform(F.col("__markov_m"), lambda m: _mean_ratio(m, models) > threshold)}
    for rank, kind in enumerate(KINDS):
        names[kind] = F.when(F.size(f"__{kind}_m") == 0, F.expr(f"cast(array() as {_SPANS})")).otherwise(_placed(F.col(f"__{kind}_m"), F.col(f"__{kind}_p"), goods[kind], rank))
    first = [c for c in out.columns if not c.startswith("__")]
    return out.select(*first, F.array_sort(F.concat(*names.values())).alias("spans"))


def _listed(spans: Column) -> Column:
    by_kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", by_kind(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base, spans): counts, and `kind:start:end` lists."""
    found = spans_of(docs, text=text, kept=[F.col(doc_id).alias("doc")], threshold=threshold)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    out = found.select("doc", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), _listed(base).alias("base"), _listed(F.col("spans")).alias("spans"))
    return out.withColumnRenamed("doc", doc_id)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", threshold: float | None = None) -> DataFrame:
    """`docs` with every span of `text` replaced by `mark`; spans that touch or overlap are one."""
    columns = docs.columns
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    found = spans_of(docs, text=text, kept=[F.struct(*(F.col(quoted(c)).alias(c) for c in columns)).alias("row")], threshold=threshold)
    body = F.col(f"row.{quoted(text)}")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
        cut = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, cut).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    clean = F.when(F.size("spans") == 0, body).otherwise(done)
    return found.select(*(clean.alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in columns))


def op6_rows(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")
