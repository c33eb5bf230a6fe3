r"""Secret scan: fixed patterns and a randomness test battery, in DataFrame functions only.

Base kinds are assign, access and hex (patterns below), found leftmost and without overlap per kind;
matches that are too short are dropped. The battery adds spans of kind random: runs of 20 or more
characters of ``[A-Za-z0-9+/_-]`` (and closing ``=``) whose encoding can be inferred (hex, base32, base36,
base62, base64, URL-safe base64; the run must hold the character classes that encoding needs) and which
carry ``MIN_BITS`` bits. A run that no encoding fits is cut at ``/``, ``-`` and ``_`` and its parts are tried.

The battery has three statistics: chi-squared uniformity over the encoding's alphabet (with its exact variance for
short strings), a runs test about the middle of the alphabet and a lag-1 serial correlation. Alphabets
number their symbols by how common they are in writing, so in words symbols stay on one side of the middle and
neighbours agree. In even draws all three are about standard normal. In words and numbers written together
they are not: how they lie there is fitted, by encoding and length, on names composed of ``WORDS`` and numbers in
``STYLES``. The three are weighted by how far their means lie apart over their variances; the weighted sum of a run,
against its mean and spread in such names, gives the probability that a name would look as random. A
Benjamini-Hochberg procedure at ``FALSE_RATE`` in each stratum of encoding and length, which keeps short runs,
whose tests have little power, from hiding behind long ones, decides which runs are added, so that of the added spans
the expected share of names is ``FALSE_RATE``. Spans that overlap a base span of their document are left out. The
procedures' ranks come from p-values binned at 1/50 of a decade, so they need counts only.

Positions come from the lengths of what stands between matches, summed by a window per text, so a
text with very many matches costs no more than sorting them. Texts without a match are never split.

Defined results: null text is empty; a text without spans has zero counts, the SHA-256 of the empty
string and an empty span list; rows repeated with one doc_id and text are scanned once and returned as
often as they occur; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

#: The patterns of the base kinds, in the order of the contract.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
KINDS = tuple(PATTERNS)
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}
#: Letters from the most to the least common one in writing.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
DIGITS = "0123456789"
#: The symbols of each encoding in the order of their numbers.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "base32": LETTERS.upper() + "234567",
    "base36": LETTERS + DIGITS,
    "base62": LETTERS + LETTERS.upper() + DIGITS,
    "base64": LETTERS + LETTERS.upper() + DIGITS + "+/",
    "base64url": LETTERS + LETTERS.upper() + DIGITS + "-_",
}
BITS = {"hex": 4.0, "base32": 5.0, "base36": 5.17, "base62": 5.954, "base64": 6.0, "base64url": 6.0}
#: Words of names, and words that are hexadecimal digits.
WORDS = (
    "get set user name list item page file path data time date load save read write open close start stop event handler test case class value index count total number string report summary version release "
    "image folder window width height button color table column order customer invoice account payment login session client server request response message email address phone city country street market price "
    "product category search filter result error warning status update delete create insert select group team project task meeting note text line word chapter section paragraph title author book library school "
    "student teacher music video photo camera battery light switch motor sensor signal network device driver kernel memory thread process"
).split()
HEX_WORDS = "face deed bad cafe feed beef dead fade decade add dad bead".split()
#: How names are written: (words, form of the first, form of the others, between them, numbers in a hundred words).
STYLES = (
    (WORDS, "title", "title", "", 20), (WORDS, "lower", "title", "", 20), (WORDS, "lower", "lower", "", 20), (WORDS, "upper", "upper", "", 20),
    (HEX_WORDS, "lower", "lower", "", 70), (WORDS, "title", "title", "/", 20), (WORDS, "title", "lower", "-", 20), (WORDS, "title", "title", "_", 20),
)
LENGTHS = (20, 22, 24, 27, 30, 34, 40, 48, 58, 72, 96, 140)
NAMES_EACH = 800
TESTS = ("uniform", "runs", "serial")
MIN_BITS = 80
FALSE_RATE = 0.05
BINS_PER_DECADE = 50
MOST_DECADES = 20


def matches_in(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, stop (code points), match, value; of every raw match."""
    text = F.col("text")

    def found(kind):
        pattern = F.lit(PATTERNS[kind])
        whole = F.regexp_extract_all(text, pattern, F.lit(0))
        value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else whole
        gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.length(p))
        zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("match"), value.alias("value"))
        zipped = F.transform(zipped, lambda z: F.struct(F.lit(kind).alias("kind"), z["gap"].alias("gap"), z["match"].alias("match"), z["value"].alias("value")))
        test = F.contains(text, F.lit("AKIA")) if kind == "access" else F.lit(True)
        return F.when(test & text.rlike(PATTERNS[kind]), zipped).otherwise(F.array().cast("array<struct<kind:string,gap:int,match:string,value:string>>"))

    parts = rows.select("doc_id", "text_key", F.posexplode(F.concat(*(found(k) for k in KINDS))).alias("at", "m"))
    parts = parts.select("doc_id", "text_key", "at", "m.*").dropDuplicates(["doc_id", "text_key", "at"])
    upto = Window.partitionBy("doc_id", "text_key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("match"), F.lit(0))
    stop = F.sum((F.col("gap") + size).cast("long")).over(upto)
    return parts.withColumn("stop", stop).withColumn("start", F.col("stop") - size).where("match is not null").select("doc_id", "text_key", "kind", "start", "stop", "match", "value")


def encoding(match: Column) -> Column:
    """The encoding of a run of characters; null where none fits."""
    core = F.regexp_replace(match, "=+$", "")
    lower, upper, digit = (core.rlike(c) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    out = F.when(core.rlike("^[0-9a-f]+$") & lower & digit | core.rlike("^[0-9A-F]+$") & upper & digit, "hex")
    out = out.when((core.rlike("^[A-Z2-7]+$") & upper | core.rlike("^[a-z2-7]+$") & lower) & digit, "base32")
    out = out.when(core.rlike("^[a-z0-9]+$") & lower & digit, "base36")
    out = out.when(core.rlike("^[A-Za-z0-9]+$") & lower & upper & digit, "base62")
    out = out.when(core.rlike("^[A-Za-z0-9+/]+$") & lower & upper & digit, "base64")
    return out.when(core.rlike("^[A-Za-z0-9_-]+$") & lower & upper & digit, "base64url")


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation of Abramowitz and Stegun, 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, n, band and the statistics z_uniform, z_runs, z_serial to rows with ``match`` that have an encoding and enough bits."""
    core = F.regexp_replace("match", "=+$", "")
    rows = runs.withColumn("encoding", encoding(F.col("match"))).where("encoding is not null")
    core = F.when(F.col("encoding") == "hex", F.lower(core)).when(F.col("encoding") == "base32", F.upper(core)).otherwise(core)
    alphabet = F.create_map(*(x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(v))))[F.col("encoding")]
    rows = rows.withColumn("core", core).withColumn("alphabet", alphabet).withColumn("n", F.length("core")).withColumn("k", F.length("alphabet"))
    bits = F.create_map(*(x for k, v in BITS.items() for x in (F.lit(k), F.lit(v))))[F.col("encoding")]
    rows = rows.where(F.col("n") * bits >= MIN_BITS)
    # Symbol numbers; counts by the distinct symbols only, at most one alphabet.
    rows = rows.withColumn("chars", F.split("core", ""))
    rows = rows.withColumn("x", F.expr("transform(filter(chars, c -> c <> ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    squares = F.aggregate(F.array_distinct("x"), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter("x", lambda y: y == s)), 2))
    n, k = F.col("n"), F.col("k")
    chi = squares * k / n - n
    rows = rows.withColumn("z_uniform", (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n))
    # Half of each alphabet lies above its middle: of even draws every second neighbour lies on the other side.
    rows = rows.withColumn("high", F.expr("transform(x, v -> v >= k / 2)"))
    changes = F.expr("size(filter(zip_with(slice(high, 1, n - 1), slice(high, 2, n - 1), (a, b) -> a <> b), d -> d))")
    rows = rows.withColumn("z_runs", (changes - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
    rows = rows.withColumn("dev", F.expr("transform(x, v -> v - (k - 1) / 2)"))
    lagged = F.expr("aggregate(zip_with(slice(dev, 1, n - 1), slice(dev, 2, n - 1), (a, b) -> a * b), 0d, (a, v) -> a + v)")
    rows = rows.withColumn("z_serial", lagged / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    most = length_band(F.lit(max(LENGTHS)))
    return rows.withColumn("band", F.least(length_band(n), most)).drop("core", "alphabet", "chars", "x", "high", "dev", "k")


def names_of(spark: SparkSession) -> DataFrame:
    """match: names of words and numbers in all STYLES and LENGTHS; the same ones in every run."""
    rows = spark.range(len(STYLES) * len(LENGTHS) * NAMES_EACH)
    rows = rows.withColumn("style", (F.col("id") % len(STYLES)).cast("int")).withColumn("n", F.get(F.lit(list(LENGTHS)), F.floor(F.col("id") / len(STYLES)).cast("int") % len(LENGTHS)))
    draw = lambda i, salt, most: F.pmod(F.xxhash64(F.col("id"), i, F.lit(salt)), F.lit(most)).cast("int")

    def written_as(words, first, others, between, numbers):
        form = {"title": F.initcap, "lower": F.lower, "upper": F.upper}

        def piece(i):
            word = F.get(F.lit(words), draw(i, 1, len(words)))
            number = F.when(draw(i, 2, 100) < numbers, draw(i, 4, 9000).cast("string").substr(F.lit(1), draw(i, 3, 3) + 1)).otherwise("")
            return F.concat(F.when(i == 0, form[first](word)).otherwise(form[others](word)), number)

        return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 3).cast("int")), piece), between), F.lit(1), F.col("n"))

    match = F.lit(None).cast("string")
    for number, style in enumerate(STYLES):
        match = F.when(F.col("style") == number, written_as(*style)).otherwise(match)
    return rows.select(match.alias("match"))


def fitted(names: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """encoding, band, weight of each of ``tests``, mean and spread of their weighted sum in names: a small table."""
    z = [F.col(f"z_{t}") for t in tests]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    rows = battery(names).groupBy("encoding", "band").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(z)), *(F.avg(z[i] * z[j]).alias(f"v{i}{j}") for i, j in pairs))
    spread = lambda i, j: F.col(f"v{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
    for i in range(len(z)):
        rows = rows.withColumn(f"w{i}", F.col(f"m{i}") / (spread(i, i) + 1))
    mean = sum((F.col(f"w{i}") * F.col(f"m{i}") for i in range(len(z))), F.lit(0.0))
    variance = sum(((1 if i == j else 2) * F.col(f"w{i}") * F.col(f"w{j}") * spread(i, j) for i, j in pairs), F.lit(0.0))
    return rows.select("encoding", "band", *(F.col(f"w{i}").alias(f"w_{t}") for i, t in enumerate(tests)), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(1e-6))).alias("spread"))


def scored(tested: DataFrame, alternative: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """Adds p: the probability that a name of the run's encoding and length looks as random."""
    sum_ = F.lit(0.0)
    for t in tests:
        sum_ = sum_ + F.col(f"w_{t}") * F.col(f"z_{t}")
    rows = tested.join(F.broadcast(alternative), ["encoding", "band"], "left")  # a row an encoding and length
    return rows.withColumn("p", F.coalesce(normal_tail((F.col("mean") - sum_) / F.col("spread")), F.lit(1.0))).drop("mean", "spread", *(f"w_{t}" for t in tests))


def length_band(n: Column) -> Column:
    return F.floor(F.log2(n) * 2).cast("int")


def discoveries(tested: DataFrame, p: str, rate: float = FALSE_RATE) -> DataFrame:
    """Adds shown: rows whose hypothesis the stepwise procedure of their stratum rejects."""
    decades = F.least(-F.log10(p), F.lit(float(MOST_DECADES)))
    rows = tested.withColumn("bin", F.floor(decades * BINS_PER_DECADE).cast("int"))
    bins = rows.groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("rows"))
    stratum = Window.partitionBy("encoding", "band")
    upto = stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("rank", F.sum("rows").over(upto)).withColumn("all", F.sum("rows").over(stratum))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    cut = bins.where(edge <= rate * F.col("rank") / F.col("all")).groupBy("encoding", "band").agg(F.min("bin").alias("cut"))
    rows = rows.join(F.broadcast(cut), ["encoding", "band"], "left")
    return rows.withColumn("shown", F.coalesce(F.col("bin") >= F.col("cut"), F.lit(False))).drop("bin", "cut")


def parts_of(runs: DataFrame) -> DataFrame:
    """Runs with an encoding, and of the others the parts between signs that have one."""
    whole = runs.where(encoding(F.col("match")).isNotNull()).select("doc_id", "text_key", "start", "stop", "match")
    rest = runs.where(encoding(F.col("match")).isNull()).select("doc_id", "text_key", "start", F.posexplode(F.split("match", "[/_-]")).alias("at", "match"))
    upto = Window.partitionBy("doc_id", "text_key", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("stop", F.col("start") + F.sum(F.length("match").cast("long") + 1).over(upto) - 1)
    rest = rest.where((F.length("match") >= LEAST["random"]) & encoding(F.col("match")).isNotNull())
    return whole.unionByName(rest.select("doc_id", "text_key", (F.col("stop") - F.length("match")).alias("start"), "stop", "match"))


def added_runs(runs: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """The runs that are shown to be no names, by ``tests`` of the battery."""
    alternative = written(fitted(written(names_of(runs.sparkSession)), tests))  # a table between keeps the plan small
    return discoveries(written(scored(battery(parts_of(runs)), alternative, tests)), "p").where("shown")


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, stop of every span that counts."""
    found = written(matches_in(docs))
    right = F.col("kind") == "random"
    for kind, least in LEAST.items():
        right = right | (F.col("kind") == kind) & (F.length("value") >= least)
    base = found.where(right & (F.col("kind") != "random")).select("doc_id", "text_key", "kind", "start", "stop")
    added = added_runs(found.where("kind = 'random'")).select("doc_id", "text_key", F.lit("random").alias("kind"), "start", "stop")
    both = base.unionByName(added)
    order = Window.partitionBy("doc_id", "text_key").orderBy("start")
    is_base = F.col("kind") != "random"
    before = F.max(F.when(is_base, F.col("stop"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("stop")) >= F.col("stop"))
    return both.where(is_base | free).select("doc_id", "text_key", "kind", "start", "stop")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row of ``docs``."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    place = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))[F.col("kind")]
    item = F.struct("start", place.alias("place"), F.concat_ws(":", "kind", "start", "stop").alias("shown"))
    found = spans_of(rows).groupBy("doc_id", "text_key").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS),
        F.sort_array(F.collect_list(item)).alias("items"),
    )
    shown = lambda items: F.array_join(F.transform(items, lambda x: x["shown"]), ",")
    found = found.select(
        F.col("doc_id").alias("s_id"),
        F.col("text_key").alias("s_key"),
        *(f"n_{k}" for k in KINDS),
        shown(F.filter("items", lambda x: x["place"] < 3)).alias("base"),
        shown(F.col("items")).alias("spans"),
    )
    out = rows.select("doc_id", "text_key").join(written(found), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left")
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op3_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
