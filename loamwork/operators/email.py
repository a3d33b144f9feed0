"""Mail: bodies, threads, participants, replies, quotes, signatures, automated mail, duplicate threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.greedy import components, cut
from ..functions.sets import jaccard, let, word_ngrams
from ..functions.text import BLANK, squash

#: Signs of automated senders.
AUTOMATED_SENDERS = [
    r"no[\-_.]?reply", r"do[\-_.]?not[\-_.]?reply", r"mailer[\-_.]?daemon", r"postmaster@",
    r"calendar[\-_.]?(notification|noreply|server)", r"notify@", r"notification", r"bounce", r"automated", r"robot@", r"bot@",
    r"daemon@", r"jenkins", r"jira@", r"confluence@", r"github\.com", r"gitlab\.com", r"bitbucket\.org", r"circleci\.com",
    r"travis-ci", r"dependabot", r"renovate", r"snyk", r"sentry", r"pagerduty", r"opsgenie", r"slack(bot)?@", r"zoom\.us",
    r"(google|microsoft|apple)[\-.]?calendar", r"venmo@", r"paypal@", r"cashapp", r"square\.com", r"stripe\.com",
    r"shopify\.com", r"uber\.com", r"lyft\.com", r"doordash\.com", r"grubhub\.com", r"linkedin\.com", r"facebook(mail)?\.com",
    r"twitter\.com", r"x\.com", r"instagram\.com", r"tiktok\.com", r"pinterest\.com", r"reddit\.com", r"quora\.com",
    r"meetup\.com", r"eventbrite\.com", r"mailchimp\.com", r"sendgrid\.(com|net)", r"amazonses\.com", r"ses\.amazonaws\.com",
    r"mailgun\.(com|org)", r"constantcontact\.com", r"hubspot\.com", r"marketo\.com", r"salesforce\.com", r"zendesk\.com",
    r"freshdesk\.com", r"intercom", r"helpscout",
]
#: Signs of automated subjects.
AUTOMATED_SUBJECTS = [
    r"^invitation:\s", r"^updated invitation:\s", r"^canceled( event)?:\s", r"^accepted:\s", r"^declined:\s", r"^tentative:\s",
    r"^reminder:\s.*meeting", r"zoom meeting invitation", r"zoom meeting reminder", r"is inviting you to a scheduled zoom meeting",
    r"join (our|my|the) (zoom|teams|meet|webex)", r"\bsign[\-\s]?in\b.*(code|alert|notification|attempt)", r"\bverification code\b",
    r"\bverify your\b", r"\bconfirm your (email|account|registration)\b", r"\bpassword reset\b", r"\btwo[\-\s]?factor\b", r"\b2fa\b",
    r"\bone[\-\s]?time (password|code|passcode)\b", r"\breceipt\b.*\b(payment|order|purchase|transaction)\b",
    r"\border confirmation\b", r"\bshipping (confirmation|notification|update)\b", r"\bdelivery (notification|update|status)\b",
    r"\bsubscription (confirm|renew|cancel|expir)", r"\bunsubscribe\b", r"\bnewsletter\b", r"\bdigest\b",
    r"\bbuild (failed|succeeded|broken|fixed)\b", r"\bpipeline (failed|succeeded)\b", r"\bCI\/CD\b", r"\bpull request\b",
    r"\bmerge request\b", r"\bcommit\b.*\bpush", r"\bissue (created|updated|closed|assigned)\b",
    r"\bticket\b.*(created|updated|closed|assigned|resolved)", r"\balert:\s", r"\bincident\b.*(created|resolved|triggered)",
    r"\bout[\-\s]?of[\-\s]?office\b", r"\bautomatic reply\b", r"\bauto[\-\s]?reply\b",
    r"\bmail delivery\b.*(failed|failure|error)", r"\bundeliverable\b", r"\bbounced?\b", r"\bmailer[\-\s]?daemon\b",
]
#: Lines that start a quoted mail.
QUOTE_LINES = [
    r"^\s*-{2,}\s*original message\s*-{2,}\s*$", r"^\s*on .+wrote:\s*$", r"^\s*begin forwarded message:\s*$",
    r"^\s*-{2,}\s*forwarded message\s*-{2,}\s*$", r"^\s*>+\s*from:\s+.+$", r"^\s*from:\s+.+$", r"^\s*sent:\s+.+$",
    r"^\s*to:\s+.+$", r"^\s*subject:\s+.+$",
]
#: Lines that start a signature.
SIGNATURE_LINES = [
    r"^\s*--\s*$", r"^\s*__+\s*$", r"^\s*best[,!\s]*$", r"^\s*best regards[,!\s]*$", r"^\s*regards[,!\s]*$", r"^\s*thanks[,!\s]*$",
    r"^\s*thank you[,!\s]*$", r"^\s*cheers[,!\s]*$", r"^\s*sent from my .+$",
]


def alternation(patterns: list[str]) -> str:
    return "(?i)(" + "|".join(patterns) + ")"


def body_text(html: Column) -> Column:
    """Tags to spaces, white space squashed (EML-02)."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br[ \t\r\n]*/?>", "\n"), r"(?i)</p[ \t\r\n]*>", "\n")
    return squash(F.regexp_replace(text, "<[^>]+>", " "))


def thread_id(references: Column, reply_to: Column, subject: Column, message_id: Column) -> Column:
    """thread_ and 16 hex digits of the first reference, reply target, bare subject or id (EML-03)."""
    bare = F.trim(F.regexp_replace(F.lower(subject), r"^(re|fw|fwd)[ \t]*:[ \t]*", ""))
    anchor = F.coalesce(F.get(references, F.lit(0)), F.nullif(reply_to, F.lit("")), F.nullif(bare, F.lit("")), message_id)
    return F.concat(F.lit("thread_"), F.substring(F.sha1(anchor), 1, 16))


def warnings(mail: DataFrame, limit: int = 200) -> DataFrame:
    """Schema warnings (id, field), in order, up to a limit (EML-04)."""
    empty = lambda c: F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(c))
    rows = mail.select("id", F.explode(F.array_compact(F.array(*map(empty, ("thread_id", "date", "subject", "body"))))).alias("field"))
    return rows.orderBy("id", "field").limit(limit)


def participant_label(value: Column) -> Column:
    """A participant's name without address marks, or the address as words (EML-05)."""
    edges = r"^[ \t,;:._\-]+|[ \t,;:._\-]+$"
    text = F.regexp_replace(squash(value), "(?i)mailto:", "")
    text = F.trim(F.regexp_replace(text, r"^\[+(.*?)\]+$", "$1"))
    inner = F.regexp_extract(text, "<([^>]*)>", 1)
    outer = F.regexp_replace(squash(F.regexp_replace(text, "<[^>]*>", " ")), edges, "")
    text = F.when(text.rlike("<[^>]*>"), F.when(outer != "", outer).otherwise(F.trim(inner))).otherwise(text)
    plain = F.regexp_replace(squash(F.regexp_replace(text, r"\[[^\]]*\]", " ")), edges, "")
    best = F.regexp_replace(squash(F.when(plain.rlike("[A-Za-z0-9]"), plain).otherwise(text)), edges, "")
    words = F.trim(F.regexp_replace(F.lower(best), "[^a-z0-9]+", " "))
    return F.when(~best.rlike("[A-Za-z0-9]"), "").when(best.contains("@"), words).otherwise(best)


def participants(mail: DataFrame) -> DataFrame:
    """Participants per mail in order of appearance, once each regardless of case (EML-06).  mail: id, people array."""
    rows = mail.select("id", F.posexplode("people").alias("pos", "p")).where(F.trim("p") != "")
    once = rows.groupBy("id", F.lower(F.trim("p")).alias("k")).agg(F.min_by(F.trim("p"), "pos").alias("p"), F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"])
    return once.groupBy("id").agg(F.array_join(ordered, "; ").alias("participants"))


def thread_documents(mail: DataFrame) -> DataFrame:
    """One row per thread: mails, participants, texts in order (EML-08, 31, 32).  mail: thread, pos, sender, body."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"]), "\n")
    people = F.array_join(F.array_sort(F.collect_set(F.lower("sender"))), ",")
    rows = mail.groupBy("thread").agg(F.count("*").alias("n_mails"), people.alias("people"), body.alias("text"))
    return rows.withColumn("signature", F.sha1(F.concat("people", F.lit("\n"), "text")))


def reply_order(mail: DataFrame, max_depth: int = 50) -> DataFrame:
    """Mails of each thread in the order of a walk over the reply tree (EML-07).

    mail: thread, id, parent (null or unknown: a root), date.  Paths grow by one
    level a round, each round an equi-join on (thread, parent); what no root
    reaches (cycles) comes last.
    """
    w = Window.partitionBy("thread").orderBy("date", "id")
    rows = mail.withColumn("key", F.lpad(F.row_number().over(w).cast("string"), 6, "0"))
    known = rows.select("thread", F.col("id").alias("parent")).withColumn("known", F.lit(True))
    rows = rows.join(known, ["thread", "parent"], "left")
    level = rows.where("known is null").select("thread", "id", F.col("key").alias("path"), F.lit(0).alias("depth"))
    done = level
    kids = rows.where("known").select("thread", F.col("parent").alias("p"), F.col("id").alias("kid"), "key")
    for depth in range(1, max_depth + 1):
        step = level.alias("l").join(kids.alias("k"), (F.col("l.thread") == F.col("k.thread")) & (F.col("l.id") == F.col("k.p")))
        level = step.select("l.thread", F.col("k.kid").alias("id"), F.concat("l.path", F.lit("/"), "k.key").alias("path"), F.lit(depth).alias("depth"))
        level = cut(level)
        if level.isEmpty():
            break
        done = done.union(level)
    rest = rows.join(done.select("thread", "id"), ["thread", "id"], "left_anti").select("thread", "id", F.concat(F.lit("~"), "key").alias("path"), F.lit(-1).alias("depth"))
    return done.union(rest).withColumn("place", F.row_number().over(Window.partitionBy("thread").orderBy("path")))


def ancestors(mail: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(thread, id, ancestor, depth) along the reply chain up to its root; a cycle ends where it closes (EML-18).

    Chains double in length each round, so a thread of a million replies takes
    twenty.  mail: thread, id, parent (null or unknown: a root).
    """
    links = mail.where("parent is not null").select("thread", F.col("id").alias("child"), F.col("parent").alias("up"))
    links = links.join(mail.select("thread", F.col("id").alias("up")).distinct(), ["thread", "up"], "left_semi")
    done = cut(links.select("thread", F.col("child").alias("id"), F.col("up").alias("ancestor"), F.lit(1).alias("depth")).where("id <> ancestor"))
    reach = 1
    for _ in range(max_rounds):
        far, on = done.where(F.col("depth") == reach).alias("l"), done.alias("k")
        step = far.join(on, (F.col("l.thread") == F.col("k.thread")) & (F.col("l.ancestor") == F.col("k.id")))
        step = step.select("l.thread", "l.id", "k.ancestor", (F.col("k.depth") + reach).alias("depth")).where("id <> ancestor")
        step = cut(step.join(done, ["thread", "id", "ancestor"], "left_anti").groupBy("thread", "id", "ancestor").agg(F.min("depth").alias("depth")))
        if step.isEmpty():
            return done
        done, reach = cut(done.union(step)), 2 * reach
    raise RuntimeError(f"chains did not end in {max_rounds} rounds")


def mergeable(overall: Column, body: Column, people: Column, limit: float = 0.9) -> Column:
    """All three similarities lie strictly above the limit (EML-13)."""
    return (overall > limit) & (body > limit) & (people > limit)


def collapse(threads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each component of duplicate threads the longest stays, then that with most mails, then the smallest id (EML-14).

    threads: id, n_chars, n_mails; a thread in no pair stays.  The best is a
    maximum per component, so a component of any size is only aggregated.
    """
    rows = threads.join(components(pairs), "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = rows.groupBy("root").agg(F.max(F.struct("n_chars", "n_mails", (-F.col("id")).alias("neg"))).alias("s"), F.count("*").alias("n"))
    return rows.join(best, "root").select("id", "root", (F.col("id") == -F.col("s.neg")).alias("kept"))


def shingles(text: Column, n: int = 5) -> Column:
    """Word n-grams hashed to 63 bits of sha1; the whole text if it is shorter; none if empty (EML-09)."""
    w = F.array_remove(F.split(F.lower(text), BLANK), "")
    grams = let(w, lambda x: F.when(F.size(x) >= n, word_ngrams(x, n)).when(F.size(x) > 0, F.array(F.array_join(x, " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(grams, lambda g: F.conv(F.substring(F.sha1(g), 1, 15), 16, 10).cast("bigint")))


PRIME = 2_147_483_647


def coefficients(n: int, seed: int = 17) -> list[tuple[int, int]]:
    """Pinned pairs (a, b) for n permutations (EML-10)."""
    import hashlib

    number = lambda k: int(hashlib.sha1(f"{seed}|{k}".encode()).hexdigest()[:7], 16)
    return [(1 + number(f"a{k}"), number(f"b{k}")) for k in range(n)]


def minhash(sets: DataFrame, bands: int = 9, rows: int = 3) -> DataFrame:
    """One key per band and id: the minima of its permutations (a x + b) mod p (EML-10, 11).  sets: id, s.

    The minima are plain aggregates over exploded shingles.  All of an id's
    shingles come from one row, so the partial aggregate shuffles one row per id.
    """
    x = sets.select("id", F.explode("s").alias("x")).select("id", F.pmod("x", F.lit(PRIME)).alias("x"))
    low = [F.min(F.pmod(F.col("x") * a + b, F.lit(PRIME))).cast("string").alias(f"m{k}") for k, (a, b) in enumerate(coefficients(bands * rows))]
    keys = [F.concat_ws("-", F.lit(str(k)), *(F.col(f"m{n}") for n in range(k * rows, (k + 1) * rows))) for k in range(bands)]
    return x.groupBy("id").agg(*low).select("id", F.array(*keys).alias("keys"))


def duplicate_pairs(texts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs (a < b) of ids whose shingles have Jaccard >= threshold (EML-11, 12).

    Equal shingle sets are one class, so a copied text gives one row.  Shingles
    are ordered by rarity; a pair over the threshold shares one of the first
    n - ceil(t n) + 1 of either, so only these meet, in sets of sizes that
    agree.  A shingle that one class alone has meets nothing: of these only
    their number is kept, and so the shuffles hold what texts share.  Passages
    that many texts share are common, and stand behind.  texts: id, text; empty
    texts pair with nothing.
    """
    sets = texts.select("id", F.array_sort(shingles(F.col("text"))).alias("s")).where(F.size("s") > 0)
    classes = cut(sets.groupBy("s").agg(F.min("id").alias("id")).withColumn("n", F.size("s")))
    terms = classes.select("id", "n", F.explode("s").alias("v"))
    common = terms.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = terms.join(common, "v")
    w = Window.partitionBy("id")
    at = F.row_number().over(w.orderBy("df", "v")) + F.col("n") - F.count("*").over(w)
    keys = shared.withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "n", "v")
    near = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    pairs = keys.alias("x").join(keys.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    a, b = classes.select(F.col("id").alias("a"), F.col("s").alias("sa")), classes.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    checked = pairs.join(a, "a").join(b, "b").withColumn("similarity", jaccard(F.col("sa"), F.col("sb")))
    return checked.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def duplicate_links(texts: DataFrame) -> DataFrame:
    """Pairs (a < b) whose components are the duplicate clusters: near copies, and each exact copy with its class's first (EML-14, 16).

    duplicate_pairs names a class of equal shingle sets by its smallest id only.
    """
    sets = texts.select("id", F.array_sort(shingles(F.col("text"))).alias("s")).where(F.size("s") > 0).select("id", F.sha2(F.array_join("s", ","), 256).alias("s"))
    first = sets.groupBy("s").agg(F.min("id").alias("a"))
    copies = sets.join(first, "s").where("a < id").select("a", F.col("id").alias("b"))
    return duplicate_pairs(texts).select("a", "b").union(copies)


def quote_start(body: Column) -> Column:
    """The number of the first line that starts a quoted mail, from 0; null without one (EML-17)."""
    lines = F.split(body, "\n")
    at = F.transform(lines, lambda x, i: F.when(x.rlike(alternation(QUOTE_LINES)), i))
    return F.array_min(at)


def unquoted(body: Column) -> Column:
    """The body before a quote (EML-17)."""
    start = quote_start(body)
    return F.when(start.isNull(), body).otherwise(F.array_join(F.slice(F.split(body, "\n"), F.lit(1), start), "\n"))


def without_signature(body: Column, tail: int = 12) -> Column:
    """The body before the first signature line among its last lines (EML-20)."""
    lines = F.split(body, "\n")
    first = lambda ls: F.array_min(F.transform(ls, lambda x, i: F.when((i >= F.size(ls) - tail) & x.rlike(alternation(SIGNATURE_LINES)), i)))
    return let(let(lines, first), lambda at: F.when(at.isNull(), body).otherwise(F.array_join(F.slice(lines, F.lit(1), at), "\n")))


def match_text(text: Column) -> Column:
    """Lower case, other than letters and digits to single spaces (EML-35)."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def clean_body(body: Column, least: int = 8) -> Column:
    """Body without quote and signature; the body itself if too little stays (EML-21)."""
    out = F.trim(without_signature(unquoted(body)))
    return F.when(F.length(match_text(out)) < least, body).otherwise(out)


def quote_match(quote: Column, ancestor: Column, threshold: float = 0.9, least: int = 40) -> Column:
    """A quote repeats an ancestor: by 4-grams or, if long, by containment; a short quote repeats nothing (EML-19)."""

    def grams(text: Column) -> Column:
        return let(F.array_remove(F.split(text, " "), ""), lambda w: F.when(F.size(w) >= 4, word_ngrams(w, 4)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    def near(s: Column) -> Column:
        cover = F.when(F.size(s["a"]) > 0, F.size(F.array_intersect(s["q"], s["a"])) / F.size(s["a"])).otherwise(0.0)
        return (F.size(s["q"]) > 0) & ((jaccard(s["q"], s["a"]) >= threshold) | (cover >= threshold))

    def compare(t: Column) -> Column:
        held = ((F.length(t["q"]) >= 80) & F.contains(t["a"], t["q"])) | ((F.length(t["a"]) >= 80) & F.contains(t["q"], t["a"]))
        by_grams = let(F.struct(grams(t["q"]).alias("q"), grams(t["a"]).alias("a")), near)
        return (F.length(t["q"]) >= least) & (t["a"] != "") & ((t["q"] == t["a"]) | held | by_grams)

    return let(F.struct(match_text(quote).alias("q"), match_text(ancestor).alias("a")), compare)


def is_automated(sender: Column, subject: Column) -> Column:
    """Sender or subject of an automated mail (EML-22)."""
    return sender.rlike(alternation(AUTOMATED_SENDERS)) | subject.rlike(alternation(AUTOMATED_SUBJECTS))


def address(name: Column, email: Column) -> Column:
    """Name and address, one of them, or unknown (EML-30)."""
    n, e = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(email, F.lit("")))
    return F.when((n != "") & (e != "") & (n != e), F.concat(n, F.lit(" <"), e, F.lit(">"))).when(n != "", n).when(e != "", e).otherwise("unknown")


def unique_ids(mail: DataFrame) -> DataFrame:
    """Blank ids get names, repeated ids a suffix by position (EML-33).  mail: thread, id, pos."""
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    rows = mail.withColumn("base", F.when(blank, F.concat(F.lit("missing_id_"), F.col("pos").cast("string"))).otherwise(F.col("id")))
    k = F.row_number().over(Window.partitionBy("thread", "base").orderBy("pos"))
    rows = rows.withColumn("k", k)
    return rows.select("thread", "pos", F.when(F.col("k") > 1, F.concat("base", F.lit("__dup_"), F.col("k").cast("string"))).otherwise(F.col("base")).alias("id"))
