"""PII by weak supervision; DataFrame functions only.

Format rules give the base spans (e-mail, IP, card, phone), which always stand. Beyond them there are four sources of
candidates: long tokens with digits or a known key prefix and ids written with spaces (`token`), what a cue word announces
(`led`: password=, pin:, token is; no placeholder such as required or null), names behind titles, labels or a known given name (`name`), and postal addresses
(`address`). Regex, gazetteer and context labelers vote for or against each; expectation maximisation over the counts of
vote patterns (a few hundred at most, whatever the corpus) estimates how often each labeler is right and, with that, the
probability that a pattern means personal data; patterns without a vote in favour are seeds of the other class. Those
probabilities are the soft labels of a naive Bayes classifier over the shape and surroundings of a candidate, which alone
decides the final spans. Texts are read once and never shuffled.

Cases: null and empty texts have no spans; spans are in code points, end exclusive; base kinds may overlap each other,
added spans overlap neither base spans nor each other (led before name before address before token); patterns run in
linear time on long runs; repeated rows count each; without candidates nothing is added; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("id", "secret", "name", "address")
SOURCES = ("led", "name", "address", "token")
_BYTE = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
PATTERNS = {
    # A run is entered at its start or where the last match ended, so that a failing run is tried once.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The gazetteer. Key prefixes of well-known services, given names, words for streets, placeholders.
KEY_PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|sk_test_|pk_live_|rk_live_|xoxb-|xoxp-|SG\\.|npm_|pypi-|hf_|eyJ"
GIVEN = (
    "Alice|Ana|Andrew|Anna|Anne|Antonio|Carlos|Carmen|Charles|Charlotte|Claire|Daniel|David|Elena|Elizabeth|Emily|Emma|"
    "Eva|Francisco|François|Franz|Friedrich|George|Hannah|Hans|Heinrich|Helen|Henry|Isabel|Jack|Jacques|James|Jane|Javier|"
    "Jean|Jennifer|John|Jorge|José|Joseph|Juan|Julia|Jürgen|Karen|Karl|Katharina|Klaus|Laura|Linda|Louis|Lucía|Luis|Manuel|"
    "Margaret|María|Marie|Martin|Mary|Matthias|Michael|Miguel|Monika|Nancy|Nicolas|Olivia|Patricia|Paul|Pedro|Peter|Pierre|"
    "Rafael|Richard|Robert|Sarah|Sofía|Sophie|Stefan|Susan|Teresa|Thomas|Ursula|William|Wolfgang"
)
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square"
BEHIND = "straße|strasse|weg|platz|allee|gasse"
IN_FRONT = "rue|avenue|boulevard|place|Calle|Avenida|Plaza"
PLACEHOLDERS = "required|optional|none|null|nil|true|false|changeme|example|redacted|hidden|unknown|missing|empty|invalid|expired|your[a-z_-]*|x{3,}|\\*{3,}"
#: Words that stand before personal data, and words that stand before other tokens with digits.
CUES = "password|passwd|passwort|passcode|pwd|pass|token|secret|bearer|credential|credentials|key|apikey|api_key|access_key|client_secret|pin|ssn|iban|passport|licence|license no|account|contraseña|clave|mot de passe|kennwort|schlüssel"
OTHER = "version|page|chapter|section|isbn|issn|doi|figure|table|model|order|invoice|build|commit|sha|md5|checksum"
NAME_CUES = "my name is|full name|name|nombre|nom|me llamo|ich heiße|je m'appelle|signed by"

_WORD = r"\p{Lu}[\p{L}'’-]+"
_CUE_END = r"[\"'`]?(?:\s(?:is|ist|es|est))?[^\p{L}0-9]*$"
#: Per source, what leads to a candidate (no part of it) and the candidate.
LEADS = {
    "led": rf"(?<![\p{{L}}\p{{N}}_])(?i:{CUES})[\"']?(?:\x20?[=:]\x20?|\x20(?i:is|ist|es|est)\x20)[\"'`]?|(?<![\p{{L}}\p{{N}}_])(?i:bearer)\x20",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.?\x20|(?i:{NAME_CUES})\x20?[:=]\x20?|(?i:my name is|me llamo|ich heiße|je m'appelle|signed by)\x20)",
    "address": "",
    "token": "",
}
CANDIDATES = {
    "led": rf"(?:{LEADS['led']})(?!(?i:{PLACEHOLDERS})(?![^\s\"'`,;<>()\[\]{{}}.!?:]))[^\s\"'`,;<>()\[\]{{}}]{{3,255}}[^\s\"'`,;<>()\[\]{{}}.!?:]",
    "name": rf"(?:{LEADS['name']}){_WORD}(?:\x20{_WORD}){{0,2}}|(?<![\p{{L}}\p{{N}}])(?:{GIVEN})(?:\x20{_WORD}){{1,2}}",
    "address": rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}[a-z]?\x20(?:{_WORD}\x20){{1,3}}(?:{STREETS})|\p{{Lu}}\p{{Ll}}{{1,40}}(?:{BEHIND})\x20[0-9]{{1,4}}[a-z]?"
    rf"|[0-9]{{1,4}},?\x20(?:{IN_FRONT})\x20(?:\p{{Ll}}{{1,6}}\x20){{0,3}}{_WORD}|(?:{IN_FRONT})\x20(?:\p{{Ll}}{{1,6}}\x20){{0,3}}{_WORD},?\x20[0-9]{{1,4}})(?![\p{{L}}\p{{N}}])",
    "token": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?+|[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4})(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9]|{KEY_PREFIXES})[A-Za-z0-9][A-Za-z0-9_+/\-]{{7,}}+={{0,2}}",
}
NATIONAL = r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,40}$"
ROUNDS = 25
SHRINK = 4.0
LABELERS = 6
#: Right and wrong votes that every labeler has beforehand; they vote 1 (personal), -1 (not) or 0.
PRIOR = (4, 1)
#: Matches whose places are worked out together: folding them costs their square.
BLOCK = 256
#: Equal stretches of a text within which candidates are held against other spans.
STRETCHES = 100
_FOUND = "array<struct<start:int,end:int,token:string,before:string,after:string>>"


def _found(text: Column, pattern: str, lead: str = "") -> Column:
    """Matches of pattern, less the lead in front, with code-point spans: array of (start, end, token, before, after)."""

    def fold(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out"))

        def step(acc, x):
            whole = acc["at"] + F.length(x["gap"])
            end = whole + F.length(x["token"])
            token = F.regexp_replace(x["token"], f"^(?:{lead})", "") if lead else x["token"]
            led = F.left(x["token"], F.length(x["token"]) - F.length(token)) if lead else F.lit("")
            one = F.struct((end - F.length(token)).cast("int").alias("start"), end.cast("int").alias("end"), token.alias("token"), F.right(F.concat(x["gap"], led), F.lit(40)).alias("before"), F.left(x["next"], F.lit(2)).alias("after"))
            return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def begins(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["token"])))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def place(m: Column, gaps: Column) -> Column:
        parts = F.transform(m, lambda x, i: F.struct(x.alias("token"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("next")))
        cut = lambda ps: F.transform(F.sequence(F.lit(0), ((F.size(ps) - 1) / BLOCK).cast("int")), lambda b: F.slice(ps, b * BLOCK + 1, F.lit(BLOCK)))
        return let(parts, lambda ps: let(cut(ps), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), fold))))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(_FOUND)).otherwise(let(F.split(text, pattern, -1), lambda gaps: place(m, gaps))))


def _valid(kind: str, token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    if kind == "ip":
        return token.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of a base kind: array of (start, end)."""
    may = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    found = F.filter(_found(text, PATTERNS[kind]), lambda x: _valid(kind, x["token"]))
    slim = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(may, slim).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _free(found: Column, taken: Column) -> Column:
    """The candidates that overlap none of the taken spans; each is only held against those of its stretches of the text."""
    last = lambda xs: F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(xs, lambda x: x["end"])), F.lit(0)))
    in_stretch = lambda width, b: F.filter(taken, lambda x: (x["start"] < (b + 1) * width) & (x["end"] > b * width))
    stretches = lambda width: F.transform(F.sequence(F.lit(0), F.lit(STRETCHES)), lambda b: in_stretch(width, b))

    def free(width: Column, near: Column) -> Column:
        of = lambda c: F.sequence((c["start"] / width).cast("int"), ((c["end"] - 1) / width).cast("int"))
        return F.filter(found, lambda c: ~F.exists(of(c), lambda b: F.exists(F.get(near, b), lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))))

    width = (F.greatest(last(found), last(taken)) / STRETCHES).cast("int") + 1
    return F.when(F.size(taken) == 0, found).otherwise(let(width, lambda w: let(stretches(w), lambda near: free(w, near))))


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, one array of spans per base kind, the candidates outside of them per source."""
    text = F.coalesce("text", F.lit(""))
    may = {"led": text.rlike("[=:]|(?i: is | ist | es | est |bearer )"), "name": text.rlike(r"\p{Lu}"), "address": text.rlike("[0-9]"), "token": text.rlike(f"[0-9]|{KEY_PREFIXES}")}
    out = docs.select("doc_id", *[base_spans(text, k).alias(k) for k in BASE], *[F.when(may[k], _found(text, CANDIDATES[k], LEADS[k])).otherwise(F.array().cast(_FOUND)).alias(f"_{k}") for k in SOURCES])
    taken = list(BASE)
    for k in SOURCES:
        every = F.concat(*[F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for x in taken])
        out = out.withColumn(f"_{k}", F.when(F.size(f"_{k}") == 0, F.col(f"_{k}")).otherwise(let(every, lambda e: _free(F.col(f"_{k}"), e))))  # noqa: B023
        taken.append(f"_{k}")
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", *BASE, *[F.col(f"_{k}").alias(k) for k in SOURCES])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _listed(source: Column, t: Column) -> Column:
    """The gazetteer's word on a candidate: known, common or unlisted."""
    known = t.rlike(f"^(?:{KEY_PREFIXES})") | (source == "name") & t.rlike(f"^(?:{GIVEN})(?![\\p{{L}}])") | (source == "address") & t.rlike(f"(?i)(?:{STREETS}|{BEHIND}|{IN_FRONT})")
    return F.when(known, "known").when(t.rlike(f"^(?i:{PLACEHOLDERS})$") | (source == "led") & t.rlike(r"^\p{L}\p{Ll}*$") & (F.length(t) < 8), "common").otherwise("unlisted")


def voted(candidates: DataFrame) -> DataFrame:
    """candidates(source, token, before, after) with `votes`, one per labeler, and `features`."""
    source, t, before, after = F.col("source"), F.col("token"), F.col("before"), F.col("after")
    digits, letters = F.regexp_count(t, F.lit("[0-9]")), F.regexp_count(t, F.lit(r"\p{L}"))
    changes = F.regexp_count(t, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    national, code = t.rlike(NATIONAL), source.isin("token", "led")
    words = F.regexp_count(t, F.lit(r"\p{Lu}\p{L}+"))
    cue = before.rlike(rf"(?i)(?<![\p{{L}}])({CUES}){_CUE_END}") & code | before.rlike(rf"(?<![\p{{L}}])(?:{TITLES})\.?\s$|(?i:{NAME_CUES})\s?[:=]?\s?$") & (source == "name")
    listed = _listed(source, t)
    votes = F.array(
        _vote(t.rlike("^[0-9a-fA-F]{12,}$") & (letters > 0) & (digits > 2) | national | (source == "address"), code & t.rlike("^[0-9 -]+$")),
        _vote(code & (F.length(t) >= 16) & (digits >= 3) & (letters >= 3) | (source == "name") & (words >= 2), (source == "token") & (F.length(t) < 12) & ~national),
        _vote(cue, before.rlike(rf"(?i)(?<![\p{{L}}])({OTHER})[^\p{{L}}0-9]*$|https?://\S*$")),
        _vote(before.rlike(r"[=:]\s*[\"'`]?$"), (source == "token") & (F.length(t) < 16) & before.rlike(r"[\p{L},.;]\s$")),
        _vote(code & (changes >= 4), (source == "token") & (changes <= 1) & (F.length(t) < 16) & ~national),
        _vote(listed == "known", listed == "common"),
    )
    shape = F.when(national, "national").when(t.rlike("^[0-9 -]+$"), "number").when(t.rlike("^[0-9a-f]+$"), "hex").when(t.rlike("^[A-Z0-9]+$"), "upper").when(t.rlike(r"^\p{L}+$"), "word").when(t.rlike("[_-]"), "parted").otherwise("mixed")
    features = F.array(
        F.concat(F.lit("source "), source),
        F.concat(F.lit("length "), F.least(F.floor(F.log2(F.length(t))), F.lit(8)).cast("string")),
        F.concat(F.lit("digits "), F.floor(4 * digits / F.length(t)).cast("string")),
        F.concat(F.lit("changes "), F.least(changes, F.lit(6)).cast("string")),
        F.concat(F.lit("shape "), shape),
        F.concat(F.lit("before "), F.when(before.rlike(r"[=:]\s*[\"'`]?$"), "=").when(before.rlike(r"\s$"), "space").otherwise("other")),
        F.concat(F.lit("cue "), F.when(cue, "yes").otherwise("no")),
        F.concat(F.lit("listed "), listed),
        F.concat(F.lit("words "), F.least(words, F.lit(3)).cast("string")),
        F.concat(F.lit("after "), F.when(after.rlike("^[\"'`]"), "quote").when(after.rlike(r"^\s|^$"), "space").otherwise("other")),
    )
    return candidates.withColumn("votes", votes).withColumn("features", features)


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(votes, p) for patterns(votes, n): the probability of personal data by expectation maximisation.

    A labeler that votes is right with a probability of its own, estimated with PRIOR added (right, wrong) votes and never
    below a half; whether it votes says nothing, so that two kinds of secrets with different labelers in favour don't
    become each other's opposite. The start is the mean vote. Patterns without a vote in favour stay at 0: nothing speaks
    for them. All patterns, 3**LABELERS at most, meet in one row.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("all"))
    every = F.col("all")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    seeded = lambda x, p: F.when(F.array_contains(x["votes"], 1), p).otherwise(0.0)
    start = F.transform(every, lambda x: seeded(x, F.lit(0.5) + F.aggregate(x["votes"], F.lit(0.0), lambda a, v: a + v) / (2.0 * LABELERS + 1)))

    def step(post: Column, _) -> Column:
        def log_odds(j: Column) -> Column:
            right = total(F.zip_with(every, post, lambda x, p: x["n"] * F.when(F.get(x["votes"], j) == 1, p).when(F.get(x["votes"], j) == -1, 1 - p).otherwise(0.0)))
            cast = total(F.transform(every, lambda x: (x["n"] * F.abs(F.get(x["votes"], j))).cast("double")))
            return let(F.greatest((right + PRIOR[0]) / (cast + sum(PRIOR)), F.lit(0.5)), lambda a: F.log(a / (1 - a)))

        yes = total(F.zip_with(every, post, lambda x, p: x["n"] * p))
        no = total(F.zip_with(every, post, lambda x, p: x["n"] * (1 - p)))
        odds = F.transform(F.sequence(F.lit(0), F.lit(LABELERS - 1)), log_odds)
        return let(F.log((yes + 1) / (no + 1)), lambda prior: let(odds, lambda w: F.transform(
            every, lambda x: seeded(x, 1 / (1 + F.exp(-(prior + total(F.zip_with(x["votes"], w, lambda v, o: v * o)))))))))

    fitted = one.select("all", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("post"))
    pairs = fitted.select(F.explode(F.zip_with("all", "post", lambda x, p: F.struct(x["votes"].alias("votes"), p.alias("p")))).alias("x"))
    return pairs.select("x.votes", "x.p")


def classifier(labelled: DataFrame) -> DataFrame:
    """(feature, weight): log-odds of each feature for labelled(features, p); the empty feature is the prior.

    Rates shrink to those of both classes together, so that a class with hardly any rows says nothing.
    """
    each = labelled.select(F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("feature"), "p")
    sums = each.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    whole = sums.where("feature = ''").select(F.col("yes").alias("all_yes"), F.col("no").alias("all_no"), F.lit(1).alias("k"))
    both = sums.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k")
    shared = SHRINK * (F.col("yes") + F.col("no")) / (F.col("all_yes") + F.col("all_no"))
    rate = F.log((F.col("yes") + shared) / (F.col("all_yes") + SHRINK)) - F.log((F.col("no") + shared) / (F.col("all_no") + SHRINK))
    prior = F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    return both.select("feature", F.when(F.col("feature") == "", prior).otherwise(rate).alias("weight"))


def added_spans(scan: DataFrame) -> DataFrame:
    """(row, kind, start, end, score) of the candidates that the classifier accepts."""
    each = F.concat(*[F.transform(k, lambda x: F.struct(F.lit(k).alias("source"), x.alias("x"))) for k in SOURCES])  # noqa: B023
    one = scan.select("row", F.explode(each).alias("c")).select("row", "c.source", "c.x.*")
    candidates = materialize(voted(one))
    patterns = candidates.groupBy("votes").agg(F.count("*").alias("n"))
    chances = materialize(reliabilities(patterns))
    # Both tables are bounded: 3**LABELERS patterns, and one map of the few values of the features.
    soft = candidates.join(F.broadcast(chances), "votes").select("features", "p")
    weights = classifier(soft).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights"))
    weights = F.broadcast(materialize(weights.withColumn("k", F.lit(1))))
    score = F.aggregate(F.concat(F.array(F.lit("")), F.col("features")), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at("weights", f), F.lit(0.0)))
    scored = candidates.withColumn("k", F.lit(1)).join(weights, "k").withColumn("score", score)
    of_code = F.when(F.col("token").rlike(r"^[0-9-]+$") | F.col("token").rlike(NATIONAL), "id").otherwise("secret")
    kind = F.when(F.col("source").isin("name", "address"), F.col("source")).otherwise(of_code)
    return scored.where("score > 0").select("row", kind.alias("kind"), "start", "end", "score")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and, per kind of BASE and ADDED, its spans as a sorted array of (start, end)."""
    scan = materialize(scanned(docs))
    added = added_spans(scan).groupBy("row").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))).alias(f"_{k}") for k in ADDED])
    both = scan.select("row", "doc_id", *BASE).join(added, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return both.select("doc_id", *BASE, *[F.coalesce(f"_{k}", none).alias(k) for k in ADDED])


def digest(*kinds: str) -> Column:
    """kind:start:end of the spans of the given kinds, in their order, comma-joined."""
    return F.array_join(F.concat(*map(_named, kinds)), ",")


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))
