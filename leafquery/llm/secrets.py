"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A text is cut at every candidate, so that the pieces between them give each candidate's place, its neighbouring
words, and the text again with secrets replaced. The forest is trained on labelled findings that are made here from
templates of real secrets and of what is mistaken for them; its trees become SQL expressions that are evaluated in the
row, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes of well-known secrets and the names that values are assigned to.
NAMES = r"(?:pass(?:word|wd|phrase)|pwd|secret(?:[_-]?key)?|(?:access|auth|refresh|session|bearer)?[_-]?token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?)"
SHAPES = {
    "private key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "cloud key id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "repository token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "service key": r"(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9_-]{16,}",
    "map key": r"AIza[0-9A-Za-z_-]{35}",
    "signed token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
# A name may end a longer one (DB_PASSWORD, dbPassword); the lookahead only spares words that nothing is assigned to.
NAMED = rf"(?=[A-Za-z0-9_.-]*+[\"'`]?\s{{0,3}}[:=])[A-Za-z0-9_.-]*(?i:{NAMES})[\"'`]?\s{{0,3}}(?::=|:|=>?)"


def _plain(closers: str) -> str:
    """A value without quotes, up to white space, to closers before it, or to the next assignment of a query or list."""
    return rf"(?:[^\s&;,?{{|\"'`)\]}}>]|(?![&;,?{{|][\"'`]?{NAMED})(?![{closers}]{{1,8}}+(?!\S))\S){{6,}}+"


# Brackets close a value only if none is opened in it. A private key is left to its shape.
UNQUOTED = rf"(?!-----BEGIN)(?:(?=[^\s(\[{{<]*+[(\[{{<]){_plain(',;\"\'`')}|{_plain(',;\"\'`)\\]}>')})"
_QUOTED = [rf"(?<={q})(?:(?:[^{q}\\\r\n]|\\[^\r\n]){{6,}}+(?={q})|(?![^{q}\r\n]*{q}){UNQUOTED})" for q in "\"'`"]
VALUE = rf"(?:(?<![\"'`]){UNQUOTED}|" + "|".join(_QUOTED) + ")"
PREFIX = rf"{NAMED}\s{{0,3}}[\"'`]?+"
RANDOM = rf"(?=[A-Za-z+/_-]*[0-9])(?:[A-Za-z0-9_-]|[+/](?!{PREFIX}{VALUE})){{20,}}+={{0,2}}"
SHAPE = r"(?<![A-Za-z0-9+/_-])(?:" + "|".join(SHAPES.values()) + ")"
#: Its group 1 is what stands before an assigned value.
CANDIDATE = rf"{SHAPE}|(?<![A-Za-z0-9_.-])({PREFIX}){VALUE}|(?<![A-Za-z0-9+/_-]){RANDOM}"
#: What any candidate holds; most texts have none of it and are done.
ANY = r"[0-9=]|(?i:" + NAMES + r")|-----BEGIN"

# Common words and letter pairs of English, words that go with secrets and with their look-alikes.
WORDS = "the and for are but not you all any can her was one our out day get has him his how man new now old see two way who did its let put say she too use that with have this will your from they know want been good much some time very when come here just like long make many more only over such take than them well were about after again could every first found great house large learn never other place plant point right small sound spell still study their there these thing think three water where which world would write table value name file user test data list item index class type string number view element page text line code build version release".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
GOOD_SIGNS = NAMES + r"|bearer|authorization|login|key is|credential"
BAD_SIGNS = r"commit|revision|sha-?1|sha-?256|sha-?512|md5|checksum|digest|integrity|etag|hash|uuid|guid|build|version|isbn|phone|serial|order|invoice|tracking|example|sample|dummy|fixture|placeholder"
HOLDERS = r"x{4,}|\*{3,}|your|change.?me|example|placeholder|^(?:none|null|true|false|undefined|password|secret)$|\.\.\.|todo|dummy|redacted|0{6,}|12345"
EXPRESSION = r"^[A-Za-z_.:>-]{3,}[(\[]|^[$%]?[{(<]|^\$[A-Za-z_]+$|^[A-Za-z_]+(?:(?:\.|->|::)[A-Za-z_]+)+$"
PATHS = r"test|example|sample|fixture|doc|vendor|node_modules|lock"

TREES, DEPTH, FINDINGS, SEED = 25, 7, 6000, 17


def features(value: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """The numbers that the forest sees: length, character classes and transitions, dictionary coverage, path, and
    the neighbouring words."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda pattern, of=value: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    low = F.lower(value)
    return [
        F.least(n, F.lit(200.0)),
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]") / n,
        count("[a-z](?=[0-9])|[0-9](?=[a-z])") / n,
        flag(low.rlike("^[0-9a-f]+$")),
        1 - F.length(F.regexp_replace(low, "(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")", "")) / n,
        count("(?i)(?:" + "|".join(PAIRS) + ")") * 2 / n,
        count("[-_./+=]") / n,
        F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) / F.least(n, F.lit(64.0)),
        flag(low.rlike(HOLDERS)),
        flag(value.rlike(SHAPE)),
        flag(F.lower(left).rlike(rf"(?:{GOOD_SIGNS})\W{{0,6}}$")),
        flag(F.lower(F.concat_ws(" ", left, right)).rlike(GOOD_SIGNS)),
        flag(F.lower(F.concat_ws(" ", left, right)).rlike(rf"\b(?:{BAD_SIGNS})\b")),
        flag(left.rlike(r"[/\\.@:]$") | right.rlike(r"^[/\\@]|^\.[a-z]{2,4}\b")),
        count("/"),
        flag(F.lower(path).rlike(PATHS)),
        flag(value.rlike(r"^[0-9_./:-]+$|^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
        count(r"\s") / n,
        count(r"[^A-Za-z0-9\s_./+=-]") / n,
        flag(value.rlike(EXPRESSION)),
    ]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n findings (value, left, right, path, label) from templates, the same ones every time; half are secrets."""
    i = F.col("id")
    hexa = lambda salt, size: F.substring(F.sha2(F.concat_ws("-", F.lit(salt), i), 512), 1, size)
    b64 = lambda salt, size: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("-", F.lit(salt), i), 512))), r"[^A-Za-z0-9]", "k"), 1, size)
    pick = lambda salt, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(of))) + 1).cast("int"))
    word = lambda salt: pick(salt, *WORDS)
    plain = F.concat_ws(" ", word("l1"), word("l2"), word("l3"), F.lit(""))
    upper = F.upper(b64("u", 16))
    name = pick("name", "password=", 'token = "', "secret: ", "api_key=", "access_key = ", "passwd: ", 'client_secret="', "auth_token: ")
    longer = pick("longer", "DB_PASSWORD=", "MYSQL_ROOT_PASSWORD: ", "SMTP_TOKEN=", 'dbPassword = "', "app.mail.password=", "AWS_SECRET_ACCESS_KEY=", '"userToken": "', "export API_KEY='")
    special = pick("special", *"$#%&*(){}[]@!.^?")
    of = lambda left: F.concat(plain, left)
    length = (F.lit(14) + F.pmod(F.xxhash64(F.lit("n"), i), F.lit(30))).cast("int")
    good = [
        (F.concat(F.lit("AKIA"), upper), plain),
        (F.concat(F.lit("AKIA"), F.upper(hexa("u2", 16))), of(pick("k0", "", "key is ", "credentials "))),
        (F.substring(hexa("p", 64), F.lit(1), length), of(name)),
        (F.substring(hexa("p2", 64), F.lit(1), length), of(name)),
        (b64("s", 40), of(name)),
        (F.concat(F.lit("ghp_"), b64("g", 36)), of(pick("k1", "", "token ", "use "))),
        (F.concat(F.lit("eyJ"), b64("j1", 18), F.lit("."), b64("j2", 40), F.lit("."), b64("j3", 43)), of(pick("k2", "Bearer ", "", "Authorization: "))),
        (F.concat(F.lit("sk-"), b64("k", 44)), of(pick("k3", "", "key ", "api_key="))),
        (F.concat(F.initcap(word("w")), hexa("w", 4), pick("w2", "!", "_x", "7", "+")), of(pick("k4", "password=", "passwd: ", "pwd="))),
        (b64("t", 24), of(pick("k5", "secret ", "token ", "login with ", "bearer "))),
        (hexa("h40", 40), of(pick("k6", 'token = "', "token=", "secret=", "api_key: "))),
        (F.concat(b64("a1", 3), special, b64("a2", 10)), of(longer)),
        (F.concat(F.initcap(word("w3")), hexa("a3", 2), special, b64("a4", 8)), of(name)),
        (F.substring(b64("a5", 40), F.lit(1), (F.lit(8) + F.pmod(F.xxhash64(F.lit("n2"), i), F.lit(9))).cast("int")), of(longer)),
        (F.concat(F.translate(F.concat(F.initcap(word("w4")), word("w5")), "oeai", "0341"), pick("dot", "", ".", special), hexa("a6", 2)), of(longer)),
        (F.concat_ws(" ", b64("a7", 5), F.concat(special, b64("a8", 6)), b64("a9", 4)), of(pick("k7", 'password = "', "db_secret: '", '"passphrase": "'))),
        (F.concat(pick("q1", "", "key=", "https://host/?k="), F.lit("AKIA"), upper, pick("q2", "", "&x=1", ",eu")), of(longer)),
    ]
    bad = [
        (hexa("c", 40), of(pick("b0", "commit ", "revision ", "sha1 ", "merged in ", "at commit "))),
        (hexa("m", 32), of(pick("b1", "md5 ", "checksum: ", "etag ", "hash "))),
        (hexa("d", 64), of(pick("b2", "sha256:", "digest ", "integrity sha256-"))),
        (F.concat_ws("-", hexa("a", 8), hexa("b", 4), hexa("c2", 4), hexa("d2", 4), hexa("e", 12)), of(pick("b3", "uuid ", "id ", "guid=", ""))),
        (F.concat_ws("/", word("p1"), word("p2"), F.concat(word("p3"), hexa("v", 2)), word("p4"), word("p5")), of(pick("b4", "/", "see /", "https://", "./"))),
        (F.concat(word("c1"), F.initcap(word("c3")), F.initcap(word("c4")), F.initcap(word("c5")), F.lit("2")), plain),
        (F.concat_ws("_", word("s1"), word("s2"), word("s3"), word("s4"), pick("s5", "2024", "v2", "01")), plain),
        (F.concat_ws("-", word("h1"), word("h2"), word("h3"), word("h4"), pick("h5", "2020", "3", "100")), plain),
        (F.regexp_replace(hexa("n", 24), "[a-f]", "7"), of(pick("b5", "order ", "number ", "call ", "serial ", ""))),
        (F.concat_ws("-", pick("y", "2023", "2024"), F.lit("01-31T10-22-59"), F.regexp_replace(hexa("z", 6), "[a-f]", "3")), plain),
        (pick("ph", "changeme", "xxxxxxxxxxxx", "your_api_key_here", "example_password", "placeholder", "password", "********", "undefined", "insert-your-token", "none-given"), of(name)),
        (F.concat(word("q1"), word("q2")), of(pick("q", "token: ", "secret = ", "password: "))),
        (hexa("f", 40), of(pick("f1", "", "object ", "tree ", "version "))),
        (F.concat(pick("e1", "os.environ[", "getenv(", "config.get(", "request.args.get(", "get_secret(", "vault.read("), pick("e2", '"', "'", ""), F.upper(word("e3")), F.lit("_"), word("e4"), pick("e5", '")', "']", ")", "])")), of(longer)),
        (F.concat(pick("t1", "${", "{{", "$(", "%(", "<", "{"), word("t2"), pick("t3", "_", "-", "."), word("t4"), pick("t5", "}", "}}", ")", ")s", ">")), of(name)),
        (F.concat_ws(" ", word("o1"), word("o2"), word("o3"), word("o4"), pick("o5", "", "your password", "2 times", "(optional)")), of(pick("o6", 'password: "', '"secret": "', "login_token = '"))),
        (F.concat_ws(".", pick("d1", "process.env", "self", "settings", "config", "app"), word("d3"), F.concat(word("d4"), pick("d5", "", "()", "[0]"))), of(longer)),
        (F.concat(pick("v1", "$", "&", "#", "%"), F.upper(F.concat_ws("_", word("v2"), word("v3"))), pick("v4", "", "%")), of(name)),
        (F.concat(word("x1"), pick("x2", "", "(", "#", "&", "/"), word("x3"), pick("x4", "?", "!", "</b>", ").", "*")), of(pick("x5", "Password: ", "token: ", "the secret: "))),
        (pick("ty", "string|undefined", "Option<String>", "varchar(255)", "str | None", "z.string()", "[String!]", "char[64]", "required|min:8", "(none)", "&str,default"), of(longer)),
        (b64("im", 60), of(pick("im2", "integrity sha512-", "data:image/png;base64,", "checksum "))),
    ]
    which = lambda options, j: reduce(lambda c, k: c.when(F.pmod(i, F.lit(len(options))) == k, options[k][j]), range(1, len(options)), F.when(F.pmod(i, F.lit(len(options))) == 0, options[0][j]))
    right = F.concat(pick("r0", '" ', " ", ", ", "\n"), word("r1"), F.lit(" "), word("r2"))
    secret = F.pmod(F.xxhash64(F.lit("half"), i), F.lit(2)) == 0
    # every place holds both kinds; only how often differs
    anywhere = pick("path", "src0", "src9", "web", "news", "config", "deploy", "tests", "docs", "vendor", "examples/app", "lib/core", "notes")
    leaning = F.when(secret, pick("path1", "config", "deploy", "src0", "web")).otherwise(pick("path2", "tests", "docs", "vendor", "src9"))
    path = F.when(F.pmod(F.xxhash64(F.lit("path0"), i), F.lit(4)) == 0, leaning).otherwise(anywhere)
    return spark.range(0, n, 1, 1).select(
        F.when(secret, which(good, 0)).otherwise(which(bad, 0)).alias("value"),
        F.when(secret, which(good, 1)).otherwise(which(bad, 1)).alias("left"),
        right.alias("right"),
        path.alias("path"),
        secret.cast("double").alias("label"),
    )


_forests: dict[int, list] = {}


def forest(spark: SparkSession, findings: DataFrame | None = None) -> list:
    """The trees as nested tuples: (feature, threshold, left, right) or a leaf's share of secrets."""
    if findings is None and (known := _forests.get(FINDINGS)):
        return known
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = (findings if findings is not None else labelled_findings(spark)).select(*[f.alias(f"f{k}") for k, f in enumerate(features(*map(F.col, ("value", "left", "right", "path"))))], "label")
    rows = VectorAssembler(inputCols=rows.columns[:-1], outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=4, featureSubsetStrategy="sqrt").fit(rows)

    def tree(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return round(float(stats[1]) / max(1e-9, sum(stats)), 4)
        cut = node.split()
        return (int(cut.featureIndex()), float(cut.threshold()), tree(node.leftChild()), tree(node.rightChild()))

    trees = [tree(t.rootNode()) for t in model._java_obj.trees()]
    if findings is None:
        _forests[FINDINGS] = trees
    return trees


def forest_score(trees: list, values: Column) -> Column:
    """The mean vote of the trees for an array of features, as nested conditions."""

    def of(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        k, at, low, high = node
        return F.when(values[k] <= at, of(low)).otherwise(of(high))

    return reduce(add, (of(t) for t in trees)) / len(trees)


def _scanned(docs: DataFrame, text: Column, path: Column, threshold: float) -> tuple[DataFrame, str]:
    """docs with an array column of candidates: at, hit, prefix, value, score, secret; and its name. Null without any."""
    spark = docs.sparkSession
    trees = forest(spark)
    some = text.rlike(ANY) & text.rlike(CANDIDATE)
    out = docs.withColumn("__text", F.when(some, text)).withColumn("__path", path)
    out = out.withColumn("__pieces", F.split("__text", CANDIDATE, -1))
    for name, group in (("__hits", 0), ("__prefixes", 1)):
        out = out.withColumn(name, F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(group)))
    sizes = F.zip_with("__pieces", "__hits", lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))
    ends = F.aggregate(sizes, F.array(F.lit(0).cast("int")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    out = out.withColumn("__ends", ends)
    parts = F.transform(
        "__hits",
        lambda h, i: F.struct(
            (F.col("__ends")[i] + F.length(F.col("__pieces")[i])).alias("at"),
            h.alias("hit"),
            F.col("__prefixes")[i].alias("prefix"),
            F.right(F.col("__pieces")[i], F.lit(80)).alias("before"),
            F.left(F.col("__pieces")[i + 1], F.lit(60)).alias("after"),
        ),
    )
    out = out.withColumn("__parts", parts)
    value = lambda x: F.substring(x["hit"], F.length(x["prefix"]) + 1, F.length(x["hit"]))
    rated = F.transform(
        "__parts",
        lambda x: F.struct(
            (x["at"] + F.length(x["prefix"])).alias("at"),
            x["hit"].alias("hit"),
            x["prefix"].alias("prefix"),
            value(x).alias("value"),
            F.array(*features(value(x), F.concat(x["before"], x["prefix"]), x["after"], F.col("__path"))).alias("f"),
        ),
    )
    out = out.withColumn("__rated", rated)
    scored = F.transform("__rated", lambda x: F.struct(x["at"].alias("at"), x["hit"].alias("hit"), x["prefix"].alias("prefix"), x["value"].alias("value"), F.round(forest_score(trees, x["f"]), 6).alias("score")))
    out = out.withColumn("__found", scored)
    return out, "__found"


def kind_of(value: Column, prefix: Column) -> Column:
    kinds = list(SHAPES.items())
    first = F.when(value.rlike(f"^(?:{kinds[0][1]})$"), kinds[0][0])
    named = reduce(lambda c, k: c.when(value.rlike(f"^(?:{k[1]})$"), k[0]), kinds[1:], first)
    return named.when(prefix != "", "assigned value").otherwise("random string")


def findings(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, at (code points before it), n_chars, kind, value_sha256, score, secret.

    secret is false for what the forest takes for a false positive. Null and empty texts have no candidates; null ids
    and repeated rows are scanned like others; further columns, whatever their names, are ignored. The whole text is
    scanned. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(path_col) if path_col else F.lit("")).alias("path"))
    out, found = _scanned(rows, F.col("text"), F.coalesce("path", F.lit("")), threshold)
    x = F.col("x")
    return out.where(F.col(found).isNotNull()).select("doc_id", F.explode(found).alias("x")).select(
        "doc_id",
        x["at"].cast("long").alias("at"),
        F.length(x["value"]).cast("long").alias("n_chars"),
        kind_of(x["value"], x["prefix"]).alias("kind"),
        F.sha2(x["value"], 256).alias("value_sha256"),
        x["score"].alias("score"),
        (x["score"] >= threshold).alias("secret"),
    )


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by the mark; no row and nothing else of a text is changed."""
    columns = docs.columns
    out, found = _scanned(docs, F.col(text_col), F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit(""), threshold)
    shown = F.transform(found, lambda x: F.when(x["score"] >= threshold, F.concat(x["prefix"], F.lit(mark))).otherwise(x["hit"]))
    out = out.withColumn("__shown", shown)
    whole = F.array_join(F.zip_with("__pieces", "__shown", lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return out.withColumn(text_col, F.when(F.col(found).isNotNull(), whole).otherwise(F.col(text_col))).select(*columns)
