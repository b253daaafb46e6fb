"""PII by bootstrapped contextual extraction, in built-in functions only.

Base entities (emails, addresses, cards, phones) come from fixed patterns and checks. With long keys that stand
behind a word like "token" (kind "secret"), they are the seeds of a graph: digit groups that blanks, dots, dashes,
slashes or brackets join are one instance, any other word that holds a digit or an @ is one too, without what leads
up to it ("tel:") or closes the sentence. The words around the whole instance, with its exact shape and with its
coarse class, are its lexical patterns. Words that as a rule are followed by something else ("the", "and") make no
pattern: the share of all their places in the corpus that an instance follows is counted, over every whole text.

A pattern's confidence is the trust in its distinct instances over their number, where those that nothing vouches for
count less. Instances of confident patterns are
trusted in turn, as far as the pattern is, and count for the other patterns they stand in; this goes on until no
instance is new. Confident patterns mark the instances that no base pattern found, under the kind "context".

Everything is linear in a text's length, but for a sort of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.exact_dedup import LOWER, UPPER
from keelson.llm.staging import documents, materialise

#: Possessive forms: same matches, no backtracking over long words. A match can only start where a run of its
#: characters does, or where the last match ended: inside a run the outcome is that of its start. A card's match of
#: fewer than 14 digits would be dropped, and no later match can start inside it and be longer.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
SECRET, FOUND = "secret", "context"
WORD = r"[^\x20\x09-\x0D]"
BLANK = r"[\x20\x09-\x0D]"
#: What stands before an instance in its own word, and what closes it: an instance ends at its last letter or digit.
LEAD = r"[^\x20\x09-\x0D0-9@+]*(?:[:=#\"'\[{<]|\((?![0-9+]))"
TAIL = r"[^\p{L}\p{N}]+$"
#: A word of digits and separators. Repeats of groups are possessive: Java then loops instead of calling itself.
_NUMBER = rf"[+(]{{0,2}}+[0-9][0-9()./+-]*+(?=[,;:!?'\"\]}}>]*+(?:{BLANK}|$))"
CANDIDATE = (
    rf"(?<!{WORD})(?:(?:{LEAD})?+(?:{PATTERNS['phone']}|{_NUMBER}(?:(?<!\.)\x20(?:-\x20)?+{_NUMBER})*+)"
    rf"|(?=[^\x20\x09-\x0D0-9@]*+[0-9@]){WORD}++)"
)
#: Words of contexts, what may stand between the last one and an instance, and what may stand between two.
_W, _S, _N = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_+(@]", r"[^\p{L}\p{N}_]"
#: Longer contexts are held by their digest.
LONG_CONTEXT = 64
#: A secret: a long key of letters and digits right behind one of these words and an = or a colon.
SECRET_NAMES = ("token", "secret", "password", "passwd", "key", "credential")
SECRET_FORM = r"^(?=.*[0-9].*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{24,}$"
MIN_SEEDS = 2
MIN_CONFIDENCE = 0.7
#: What an instance that nothing vouches for yet counts against a pattern, where one that is trusted counts 1.
UNKNOWN = 0.5
MIN_SHARE = 0.2
#: Sums are taken by blocks of 2^BLOCK_BITS.
BLOCK_BITS = 6
_SPAN = "struct<start:int,ord:int,kind:string,end:int>"


def found(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(x: Column, op=lambda a, b: a + b) -> Column:
    """Running sums (or maxima) of an array of integers of at least one, from 0.

    An array can't grow in place: appending one by one would copy it each time. So blocks are summed, blocks of blocks,
    and each place adds what lies before it in its block.
    """
    fold = lambda a: F.aggregate(a, F.lit(0), op)
    block = lambda i: F.shiftright(i, BLOCK_BITS)
    inside = lambda a, i: fold(F.slice(a, i - i.bitwiseAND(F.lit(2**BLOCK_BITS - 1)) + 1, i.bitwiseAND(F.lit(2**BLOCK_BITS - 1))))
    sums = lambda a: F.transform(F.sequence(F.lit(0), block(F.size(a) - 1)), lambda b: fold(F.slice(a, b * 2**BLOCK_BITS + 1, F.lit(2**BLOCK_BITS))))

    def of(one: Column, two: Column) -> Column:
        before2 = F.transform(two, lambda _, i: fold(F.slice(two, F.lit(1), i)))
        before1 = bind(before2, lambda b2: F.transform(one, lambda _, i: op(b2[block(i)], inside(one, i))))
        return bind(before1, lambda b1: F.transform(x, lambda v, i: op(op(b1[block(i)], inside(x, i)), v)))

    return bind(sums(x), lambda one: bind(sums(one), lambda two: of(one, two)))


def located(text: Column, regex: str, hint: Column | None = None, sides=None) -> Column:
    """Array of structs (start, end, match) in code points; ``sides(left, right)`` adds columns.

    ``left`` and ``right`` are what lies around a match, over one more match.
    """

    def build(m: Column, gaps: Column, ends: Column) -> Column:
        past = lambda a, k: F.coalesce(F.get(a, k), F.lit(""))

        def one(x: Column, i: Column) -> Column:
            own = [(ends[i] - F.length(x)).alias("start"), ends[i].alias("end"), x.alias("match")]
            if sides:
                own += sides(F.concat(past(gaps, i - 1), past(m, i - 1), gaps[i]), F.concat(gaps[i + 1], past(m, i + 1), past(gaps, i + 2)))
            return F.struct(*own)

        return F.transform(m, one)

    def some(m: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(m, lambda x, i: F.length(gaps[i]) + F.length(x))
            return bind(bind(steps, lambda x: running(x)), lambda ends: build(m, gaps, ends))

        return F.when(F.size(m) > 0, bind(F.split(text, regex, -1), with_gaps))

    # A lambda computes anew what it reads, so arrays are first bound to names: bind().
    out = bind(found(text, regex), some)
    return F.coalesce(out if hint is None else F.when(hint, out), F.array())


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    def total(d: Column) -> Column:
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(
            F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i))
        )

    return bind(F.reverse(digits(s)), total) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return s.rlike("^" + r"\.".join([part] * 4) + "$")
    if kind == "card":
        return F.length(digits(s)).between(14, 19) & luhn(s)
    if kind == "phone":
        return F.length(digits(s)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, ord, kind, end) of all base entities, by start, then kind."""
    hints = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][\\x20-]?[0-9][\\x20-]?[0-9]")}

    def of(k: int, kind: str) -> Column:
        kept = F.filter(located(text, PATTERNS[kind], hints[kind]), lambda m: valid(kind, m["match"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])).cast(f"array<{_SPAN}>")


def covered(cores: Column, base: Column) -> Column:
    """For each of some stretches in order: whether a base span shares a character with it.

    Starts of base spans and ends of stretches are sorted together; the furthest end so far tells.
    """
    ends = F.transform(cores, lambda c, i: F.struct(c["end"].alias("at"), i.alias("i"), F.lit(0).alias("to")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(2**31 - 1).alias("i"), b["end"].alias("to")))

    def swept(events: Column) -> Column:
        reach = bind(F.transform(events, lambda e: e["to"]), lambda x: running(x, lambda a, b: F.greatest(a, b)))
        marked = bind(reach, lambda r: F.transform(events, lambda e, k: F.struct(e["i"].alias("i"), r[k].alias("reach"))))
        own = F.filter(marked, lambda e: e["i"] < 2**31 - 1)
        return F.transform(own, lambda e: e["reach"] > cores[e["i"]]["start"])

    return F.when(F.size(cores) > 0, bind(F.array_sort(F.concat(ends, starts)), swept)).otherwise(F.array().cast("array<boolean>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def plain(c: Column) -> Column:
    """A-Z in lower case, one digit and one kind of blank for all: one pass."""
    return F.translate(c, UPPER + "123456789\t\n\x0b\f\r", LOWER + "0" * 9 + " " * 5)


def context_key(c: Column) -> Column:
    return F.when(F.length(c) > LONG_CONTEXT, F.sha2(c, 256)).otherwise(F.btrim(c))


def context_words(text: Column) -> Column:
    """What ``l1`` of an instance would be at every word of a text, as an array still to be put through context_key."""
    return F.regexp_extract_all(plain(text), F.lit(f"{_W}++{_S}*+"), F.lit(0))


def stretches(text: Column) -> Column:
    """Identifier-like stretches without what leads up to them and what closes them: (start, end, token, l1, l2, r1).

    l1 and l2 are the word and the two words before, r1 is the word after.
    """

    def before(left: Column, words: str) -> Column:
        # Read backwards from the instance: the pattern is tried at one place only.
        return F.reverse(F.regexp_extract(F.reverse(plain(left)), f"^({words})", 1))

    def core(m: Column) -> Column:
        lead = F.regexp_extract(m["match"], f"^(?:{LEAD})?", 0)
        token = F.regexp_replace(F.substring(m["match"], F.length(lead) + 1, F.length(m["match"])), TAIL, "")
        start = m["start"] + F.length(lead)
        closing = F.substring(m["match"], F.length(lead) + F.length(token) + 1, F.length(m["match"]))
        left, right = F.concat(m["left"], lead), F.concat(closing, m["right"])
        return F.struct(
            start.alias("start"), (start + F.length(token)).alias("end"), token.alias("token"),
            before(left, f"{_S}*+{_W}++").alias("l1"), before(left, f"{_S}*+{_W}++{_N}*+{_W}++").alias("l2"),
            F.regexp_extract(plain(right), f"^({_N}*+{_W}++)", 1).alias("r1"),
        )

    around = lambda left, right: [left.alias("left"), right.alias("right")]
    like = lambda x: (F.length(digits(x["token"])) >= 4) | x["token"].rlike(".@.")
    return F.filter(F.transform(located(text, CANDIDATE, text.rlike("[0-9@]"), around), core), like)


def instances(cores: Column, hits: Column, names: tuple[str, ...] = SECRET_NAMES) -> Column:
    """Of ``stretches`` and ``covered``: (start, end, token, covered, secret, l1, patterns). Long keys behind one of ``names`` are secrets."""
    named = rf"(?:{'|'.join(names)})\s*[=:][^\p{{L}}\p{{N}}]*$"
    shape = lambda c: F.regexp_replace(F.translate(c, "123456789", "000000000"), "[A-Za-z]+", "a")

    def forms(token: Column) -> Column:
        """The exact shape; the coarse class; and one class of all numbers, with separators or without."""
        number = token.rlike(r"^[0-9\x20()./+-]+$")
        coarse = F.when(token.contains("@"), "@").when(token.rlike("^[0-9]+$"), "digits").when(number, "separated").otherwise("mixed")
        return F.array_compact(F.array(F.concat(F.lit("~"), shape(token)), F.concat(F.lit("~~"), coarse), F.when(number, F.lit("~~number"))))

    def contexts(l1: Column, l2: Column, r1: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(l2 != "", F.concat(F.lit("L:"), context_key(l2))),
                F.when(l1 != "", F.concat(F.lit("L1:"), context_key(l1))),
                F.when((l1 != "") & (r1 != ""), F.concat(F.lit("LR:"), context_key(l1), F.lit("|"), context_key(r1))),
            )
        )

    def one(x: Column, hit: Column) -> Column:
        secret = ~hit & x["l1"].rlike(named) & x["token"].rlike(SECRET_FORM) if names else F.lit(False)
        pats = bind(forms(x["token"]), lambda fs: F.flatten(F.transform(contexts(x["l1"], x["l2"], x["r1"]), lambda c: F.transform(fs, lambda f: F.concat(c, f)))))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lower(x["token"]).alias("token"), hit.alias("covered"), secret.alias("secret"),
            context_key(x["l1"]).alias("l1"), pats.alias("patterns"),
        )

    return bind(cores, lambda cs: bind(hits, lambda hit: F.transform(cs, lambda x, i: one(x, hit[i]))))


def described(rows: DataFrame, names: tuple[str, ...] = SECRET_NAMES) -> DataFrame:
    """Adds to rows with a column _text the arrays base (spans) and inst (instances)."""
    # In steps: an expression of all would be nested deeper than the analyser goes.
    found = rows.withColumn("base", base_spans(F.col("_text"))).withColumn("_cores", stretches(F.col("_text")))
    hits = bind(F.col("_cores"), lambda cs: covered(cs, F.col("base")))
    return found.withColumn("_hits", hits).withColumn("inst", instances(F.col("_cores"), F.col("_hits"), names)).drop("_cores", "_hits")


def specific_words(each: DataFrame, texts: DataFrame) -> DataFrame:
    """(l1): contexts of two distinct instances or more, where an instance follows at MIN_SHARE of all places at least.

    Every place in ``texts`` (column _text) is counted; of words that stand before no instance only the partial counts travel.
    """
    near = each.where("l1 <> ''").groupBy("l1").agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("lo"), F.max("token").alias("hi"))
    near = materialise(near.where("lo <> hi").select("l1", "n"))
    places = texts.select(F.explode(context_words(F.col("_text"))).alias("c")).select(context_key(F.col("c")).alias("l1"))
    all_ = places.groupBy("l1").agg(F.count(F.lit(1)).alias("places")).join(near.select("l1"), "l1", "left_semi")
    return materialise(near.join(all_, "l1").where(F.col("n") >= MIN_SHARE * F.col("places")).select("l1"))


def confident_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, confidence) from distinct edges (pattern, token, seed).

    confidence = sum of the scores of the pattern's tokens / (number of those with a score + UNKNOWN * number of the others
    + 0.5). Seeds score 1. Confident patterns (at least MIN_CONFIDENCE, and MIN_SEEDS tokens of any score) give their confidence,
    the largest, as score to tokens that had none; these count from then on. Ends when no token is new; scores fall from hop to hop, so soon. Everything is a sum per pattern
    or token: no group is gathered.
    """
    score = edges.where("seed").select("token", F.lit(1.0).alias("score")).distinct()
    while True:
        held = edges.select("pattern", "token").join(score, "token", "left")
        good = held.groupBy("pattern").agg(
            (F.sum("score") / (F.count("score") * (1 - UNKNOWN) + F.count(F.lit(1)) * UNKNOWN + 0.5)).alias("confidence"), F.count("score").alias("trusted")
        ).where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("trusted") >= MIN_SEEDS)).select("pattern", "confidence")
        new = materialise(held.where("score IS NULL").join(good, "pattern").groupBy("token").agg(F.max("confidence").alias("score")))
        if new.isEmpty():
            return good
        score = score.unionByName(new)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secret_names: tuple[str, ...] = SECRET_NAMES) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_context, n_spans.

    ``secret_names`` are the words, in lower case and as patterns, behind which a long key is a secret and so a seed; none leave only base
    entities as seeds. Counts of kinds and the digest are of base entities; ``spans`` has those, secrets and discovered ones, by start, then kind.
    Null texts count as empty: no spans. Rows that repeat an identifier, or have none, get the result of their own text;
    an empty table gives an empty one; other columns are ignored, whatever their names. Texts may be long: work grows with
    the length, but for a sort of the spans. Of patterns equal in confidence either gives the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text, F.col(id_col)).alias("_sig"), text.alias("_text"))
    seen = materialise(described(rows, secret_names).select("_id", "_sig", "base", "inst"))
    each = seen.where(F.size("inst") > 0).select("_id", "_sig", F.explode("inst").alias("i")).select("_id", "_sig", "i.*")
    marked = each.join(specific_words(each, rows), "l1", "left_semi").withColumn("pattern", F.explode("patterns"))
    edges = materialise(marked.groupBy("pattern", "token").agg(F.max(F.col("covered") | F.col("secret")).alias("seed")))
    good = confident_patterns(edges).select("pattern")
    places = [F.col("_id").alias("_new_id"), F.col("_sig").alias("_new_sig")]
    span = lambda k, kind: F.struct(F.col("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), F.col("end")).alias("span")
    context = marked.where("NOT covered AND NOT secret").join(good, "pattern", "left_semi").select(*places, span(len(KINDS) + 1, FOUND))
    secret = each.where("secret").select(*places, span(len(KINDS), SECRET))
    new = context.unionByName(secret).groupBy("_new_id", "_new_sig").agg(F.collect_set("span").alias("new"))
    same_row = (F.col("_sig") == F.col("_new_sig")) & F.col("_id").eqNullSafe(F.col("_new_id"))
    out = seen.select("_id", "_sig", "base").join(new, same_row, "left")
    every = F.array_sort(F.concat("base", F.coalesce(F.col("new"), F.array().cast(f"array<{_SPAN}>"))))

    def count(kind: str, spans: str = "base") -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("_id", "base", every.alias("every")).select(
        F.col("_id").alias(id_col), *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"),
        count(SECRET, "every"), count(FOUND, "every"), F.size("every").cast("long").alias("n_spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
