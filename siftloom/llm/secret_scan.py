"""Secret scans: candidates by pattern, judged by a random forest over what they and their surroundings look like.

Whatever may be a secret is a candidate: a whole private key block, what stands
before the @ of an address, any value behind a secret-like name, a known prefix
and any long run of key-like characters. The forest removes false positives by
length, character transitions, dictionary coverage, path and neighbouring
words. It is grown on labelled findings and compiled into SQL conditions, so
scanning is DataFrame functions within a row: no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm.common import cut

MASK = "[REDACTED]"
#: Code points that mark where a candidate begins and ends.
MARKS = "\ufdd0\ufdd1"
#: Lengths that are summed at once.
SUMMED = 256
#: Characters before and after a candidate that are looked at.
AROUND = 48
TREES, DEPTH, SEED, THRESHOLD = 16, 6, 7, 0.5
#: Synthetic findings that the default forest is grown on, whatever the data.
FINDINGS = 4000

# What candidates, their neighbours and their parts look like.
# Groups are possessive, so that texts of any length are read without backtracking or a deep stack.
_NAME = r"(?i:secret|token|passw|passphrase|pwd|api[_ -]?key|auth|bearer|credential|access[_ -]?key|private)"
#: The short look back comes first, as it spares most words the long one.
_BEHIND_NAME = rf"(?<=[=:>\s\"'])(?<=[=:]>?\s{{0,4}}[\"']?)(?<={_NAME}[A-Za-z0-9_.-]{{0,24}}[\"'\]]{{0,2}}\s{{0,4}}[=:]{{1,2}}>?\s{{0,4}}[\"']?)(?![\s=:>\"'])(?!(?i:bearer|basic)\s)(?![A-Za-z][A-Za-z0-9+.-]{{0,20}}://)"
_QUOTED = r"(?<=\")(?:[^\"\\\r\n]|\\.)++(?=\")|(?<=')(?:[^'\\\r\n]|\\.)++(?=')"
#: To the next blank; a closing mark ends it where a blank or the next assignment follows.
_PLAIN = r"(?:[^\s\"',;&)\]}]|[\"'](?=[A-Za-z0-9])|[,;&)\]}](?!\s|$|[\"',;&)\]}]|[A-Za-z_][A-Za-z0-9_.-]{0,40}\s{0,2}[=:]))++"
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,32}PRIVATE KEY(?: BLOCK)?-----|(?:\s++[A-Za-z0-9+/=]{16,}+)*+)"
    r"|(?<![A-Za-z0-9])(?:(?<=://)[^\s/:@\"'<>]*+:(?:[^\s:@\"'<>]|:(?!//))++(?:@[^\s@/,;\"'<>]++(?=@))*+(?=@)"
    rf"|{_BEHIND_NAME}(?:{_QUOTED}|{_PLAIN})"
    r"|(?<=[ \t])(?<=(?i:rer|sic)[ \t]{1,2})(?<=(?i:bearer|authorization[\"']?[=:]\s?[\"']?basic)[ \t]{1,2})[A-Za-z0-9._~+/-][A-Za-z0-9._~+/=-]*+"
    r"|(?<![^\s\"'=(,;<>\[])[A-Za-z0-9._+%-]++:[^\s@/:\"'<>]++(?=@)"
    r"|(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_(?:live|test)_|xox[abprs]-|AIza|eyJ|npm_)(?=[A-Za-z0-9_.+/=-]{8})(?:[A-Za-z0-9_+/=-]|\.(?=[A-Za-z0-9_-]))++"
    r"|(?:(?<![A-Za-z0-9+/_-])(?!(?<=:)//)|(?<=://))[A-Za-z0-9+/_-]{16,}+={0,2})"
)
SECRET_WORDS = r"(?i)(secret|token|passw|passphrase|pwd|api[_ -]?key|apikey|auth|bearer|credential|access[_ -]?key|private)"
OTHER_WORDS = r"(?i)(sha[0-9]*|md5|hash|commit|checksum|digest|uuid|guid|isbn|phone|card|order|version|build|example|sample|dummy|placeholder|revision|image|base64|account|invoice)"
KNOWN_START = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_(live|test)_|xox[abprs]-|AIza|eyJ|npm_)"
#: What stands where a value would: names of variables, calls, templates, masks and empty words.
REFERENCE = r"(?i)[(){}\[\]<>]|^[$]|^[a-z_]+([.][a-z_]+)+$|^(your|example|placeholder|change[_-]?me|none|null|nil|true|false|required|optional|string|str|int|bool|undefined|todo)([^a-z]|$)|^[*x.#_-]+$"
DICTIONARY = (
    "about access account action address admin after agent alert align annual archive article artist asset author average backup banner basic before bench block board border "
    "bottom branch bridge browser bucket buffer build button cache camera cancel center change channel chapter chart check class client close cloud cluster code color column "
    "commit common config connect contact content context control cookie copy count country cover create credit current custom daily data date debug default delete demo design "
    "desktop detail device direct display docs document domain download driver dummy edit email empty enable engine entry error event example export extra factory feature field "
    "file filter final first fixture folder footer form format front gallery game general global grid group guide header height hello help hidden history home host html icon "
    "image import index info inner input install item java json label large layout left legacy length letter level library light line link list local login main manager market "
    "master media member menu message method minute mobile mock model module month name native network news node normal note notice number object office online option order "
    "other output owner package page panel parent part partner path pattern people phone photo placeholder plugin point policy popup post power press price print privacy product "
    "profile project public query quick random range read record region release report request reset result review right root router sample schedule schema screen script search "
    "second section select server service session setting share shop simple site small social sort source space spec stage standard start state static status store stream string "
    "style submit summary support switch system table target task team template test text theme thumb time title today tool total track train travel type update upload user "
    "value vendor version video view visit volume week widget width window work world your"
).split()
#: A secret-like name and what joins it to its value, right before a candidate.
VALUED = rf"({_NAME}[A-Za-z0-9_.-]{{0,24}}[\x22\x27\]]{{0,2}}\s{{0,4}}[=:]{{1,2}}>?\s{{0,4}}[\x22\x27]?|(?i)bearer\s+|basic\s+)$"
CHECKED_PATH = r"(?i)(^|[ /_.-])(test|tests|spec|mock|mocks|example|examples|sample|samples|fixture|fixtures|docs?)([/_.-]|$)"

#: The last path before a candidate, as compilers and diffs name files.
NAMED_PATH = r"([A-Za-z0-9_.-]*/[A-Za-z0-9_./-]*)[^/]*$"

#: Parts of the long words of several languages.
SYLLABLES = ("th", "er", "ung", "tion", "keit", "sch", "en", "lich", "ment", "eur", "que", "ent", "ing", "hers", "ein", "ver", "ge", "aus", "con", "por", "ado", "mente", "st", "ie", "zu", "on", "ou", "an", "rat", "her", "tz", "ell")

#: What stands for a secret in examples and code.
REFERENCES = ("os.environ[x]", "getenv(TOKEN)", "config.get(x)", "settings.password", "<your-token>", "<password>", "********", "xxxxxxxx", "null", "none", "true", "false", "required", "string", "$(PASSWORD)", "$TOKEN", "get_password()", "changeme", "{{ secret }}", "str")

#: Names of the forest's inputs, in order.
FEATURES = (
    "length", "digits", "capitals", "small", "switches", "vowel_steps", "distinct", "hexadecimal", "only_digits", "dictionary", "slashes",
    "in_address", "checked_path", "secret_words", "assigned", "other_words", "quoted", "known_start", "structural", "before_at",
    "behind_scheme", "port", "blanks", "symbols", "reference", "valued",
)


def _raw(pattern: str) -> str:
    """A SQL raw string; quotes as code points of the pattern."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _features(c: str, before: str, after: str, path: str) -> str:
    """SQL of the inputs, as a struct, for a candidate and its surroundings."""
    share = lambda pattern: f"regexp_count({c}, {_raw(pattern)}) / length({c})"
    flag = lambda test: f"double({test})"
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    values = {
        "length": f"double(length({c}))",
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "small": share("[a-z]"),
        "switches": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_steps": share("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
        "distinct": f"size(array_distinct(split({c}, ''))) / length({c})",
        "hexadecimal": flag(f"{c} rlike '^([0-9a-f]+|[0-9A-F]+)$'"),
        "only_digits": flag(f"{c} rlike '^[0-9]+$'"),
        "dictionary": f"(length({c}) - length(regexp_replace(lower({c}), {_raw(words)}, ''))) / length({c})",
        "slashes": f"double(length({c}) - length(replace({c}, '/', '')))",
        "in_address": flag(f"{before} rlike {_raw(r'(https?://|www[.]|/)[^ ]*$')}"),
        "checked_path": flag(f"concat({path}, ' ', regexp_extract({before}, {_raw(NAMED_PATH)}, 1)) rlike {_raw(CHECKED_PATH)}"),
        "secret_words": flag(f"{before} rlike {_raw(SECRET_WORDS)}"),
        "assigned": flag(f"{before} rlike {_raw(r'[=:][ ]?[' + chr(34) + r'\x27]?$')}"),
        "other_words": flag(f"concat({before}, regexp_extract({c}, '^[a-z0-9]+[-_:]', 0)) rlike {_raw(OTHER_WORDS)}"),
        "quoted": flag(f"{after} rlike {_raw('^[' + chr(34) + r'\x27]')}"),
        "known_start": flag(f"{c} rlike {_raw(KNOWN_START)}"),
        "structural": flag(f"{c} rlike {_raw('^-----BEGIN|^[^:]*:.+$')}"),
        "before_at": flag(f"{after} rlike '^@'"),
        "behind_scheme": flag(f"{before} rlike '://$'"),
        "port": flag(f"{c} rlike '^[^:]*:[0-9]{{1,5}}(/|$)'"),
        "blanks": share(r"\s"),
        "symbols": share("[^A-Za-z0-9\\s]"),
        "reference": flag(f"{c} rlike {_raw(REFERENCE)}"),
        "valued": flag(f"{before} rlike {_raw(VALUED)}"),
    }
    return "named_struct(" + ", ".join(f"'{k}', {values[k]}" for k in FEATURES) + ")"


def with_candidates(rows: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Adds ``candidates``: array of structs (start, stop, value, inputs), in the text's order; empty where there is none.

    Offsets count characters from 0. The candidates are marked once by two
    code points that no text may hold (those in the text become U+FFFD, so
    offsets stay), and cut apart there. What stands before a candidate is looked at
    as far as the candidate before the last, what stands behind it as far as the next;
    the work grows with the text and not with it times its candidates. ``_parts``
    stays for :func:`redacted`.
    """
    first, last = MARKS
    marked = F.when(F.col(text).rlike(CANDIDATE), F.regexp_replace(F.translate(text, first + last, "��"), f"({CANDIDATE})", f"{first}$1{last}"))
    rows = rows.withColumn("_parts", F.when(marked.isNotNull(), F.split(marked, first)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_values", F.expr(f"transform(slice(_parts, 2, greatest(size(_parts) - 1, 0)), p -> substring_index(p, '{last}', 1))"))
    rows = rows.withColumn("_lengths", F.expr("transform(_parts, (p, i) -> if(i = 0, length(p), length(p) - 1))"))
    # the sums of the lengths before each candidate, by whole blocks and what is over
    rows = rows.withColumn("_blocks", F.expr(f"if(size(_parts) = 0, array(), transform(sequence(0, (size(_parts) - 1) div {SUMMED}), b -> aggregate(slice(_lengths, b * {SUMMED} + 1, {SUMMED}), 0, (a, x) -> a + x)))"))
    rows = rows.withColumn("_above", F.expr("transform(_blocks, (x, b) -> aggregate(slice(_blocks, 1, b), 0, (a, x) -> a + x))"))
    rows = rows.withColumn(
        "_starts", F.expr(f"transform(_values, (v, i) -> aggregate(slice(_lengths, ((i + 1) div {SUMMED}) * {SUMMED} + 1, (i + 1) % {SUMMED}), if((i + 1) div {SUMMED} < size(_above), _above[(i + 1) div {SUMMED}], 0), (a, x) -> a + x))")
    )
    pieces = (
        "transform(_values, (v, i) -> named_struct('start', _starts[i], 'stop', _starts[i] + length(v), 'value', v, "
        f"'before', right(translate(concat(if(i = 0, '', _parts[greatest(i - 1, 0)]), _parts[i]), '{last}', ''), {AROUND}), 'after', left(substring_index(_parts[i + 1], '{last}', -1), {AROUND})))"
    )
    rows = rows.withColumn("_pieces", F.expr(pieces))
    inputs = _features("c.value", "c.before", "c.after", f"coalesce({path}, '')")
    rows = rows.withColumn("candidates", F.expr(f"transform(_pieces, c -> named_struct('start', c.start, 'stop', c.stop, 'value', c.value, 'inputs', {inputs}))"))
    return rows.drop("_values", "_lengths", "_blocks", "_above", "_starts", "_pieces")


def synthetic_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings (id, text, path, label) by rule, half of them secrets: keys of known kinds in assignments and addresses against sums, ids, numbers, paths and placeholders."""
    base = spark.range(n).selectExpr("id", "sha2(concat('a', id), 256) AS h", "sha1(concat('b', id)) AS s", "base64(unhex(sha2(concat('c', id), 256))) AS b", "md5(concat('d', id)) AS m", "int(conv(substr(md5(concat('e', id)), 1, 6), 16, 10)) AS k")
    pick = lambda key, words: "element_at(split('" + "|".join(words) + f"', '[|]'), 1 + int({key}) % {len(words)})"
    fill = ["the value of this entry", "and then they were", "please see below", "it is not for all", "in order to run it", "a note on what follows", "un mot de plus", "der erste von allen", "para todo el mundo"]
    keys = ["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "apikey", "private_token", "pwd", "bearer", "TOKEN", "SECRET_KEY"]
    joins = [" = \"", "=\"", ": \"", "=", ": ", " = "]
    other = ["commit", "sha1", "md5", "checksum", "digest", "revision", "uuid", "build", "hash", "image", "version"]
    numbers = ["card", "account", "order", "invoice", "phone", "", "", "", "", "nr", "isbn"]
    close = "if(instr(%s, '\"') > 0, '\"', '')"
    key, join = pick("k / 7", keys), pick("k / 91", joins)
    digits = "substr(translate(h, 'abcdef', '123456'), 1, 12 + k % 12)"
    plain = "regexp_replace(b, '[+/=]', 'x')"
    letters = "translate(concat(h, m), '0123456789', 'qwzxjkvupy')"
    weak = "concat(substr(translate(h, '0123456789', 'ghijklmnop'), 1, 3 + k % 5), 10 + k % 9990)"
    strong = "concat(substr(regexp_replace(b, '[+/=]', 'r'), 1, 3 + k % 6), " + pick("k / 11", ["&", "!", "#", "_", "?", "%", "+", "$"]) + ", k % 1000, substr(regexp_replace(b, '[+/=]', 't'), 20, 1 + k % 4))"
    long = "concat(" + ", ".join(pick(f"k / {n}", SYLLABLES) for n in (1, 7, 17, 31, 97, 211, 501)) + ")"
    word = f"CASE k % 5 WHEN 1 THEN initcap({long}) WHEN 2 THEN upper({long}) ELSE {long} END"
    scheme, host = pick("k / 13", ["redis", "postgres", "mysql", "amqp", "https", "mongodb+srv", "ftp"]), pick("k / 29", ["cache:6379", "db", "host.example.com", "mail6.example.com", "example.org"])
    kind, title = pick("k", ["", "RSA ", "EC ", "OPENSSH "]), "initcap(%s)"
    value = (
        f"CASE id % 32 WHEN 0 THEN concat({key}, {join}, s, {close % join}) WHEN 1 THEN concat({key}, {join}, substr(h, 1, 32 + 8 * (k % 5)), {close % join}) WHEN 2 THEN concat({key}, {join}, b, {close % join})"
        f" WHEN 3 THEN concat({key}, {join}, substr(regexp_replace(b, '[+/=]', 'x7'), 1, 20 + k % 20), {close % join}) WHEN 4 THEN concat({pick('k / 5', ['', 'key ', 'id = '])}, 'AKIA', upper(substr(h, 1, 16)))"
        f" WHEN 5 THEN concat({pick('k / 5', ['', 'token ', 'use '])}, {pick('k / 3', ['ghp_', 'sk-', 'xoxb-', 'glpat-', 'npm_'])}, substr(regexp_replace(b, '[+/=]', 'a1'), 1, 36))"
        f" WHEN 6 THEN concat('https://user:', substr(h, 1, 12), '@host.example.com/x') WHEN 7 THEN {pick('k', ['-----BEGIN RSA PRIVATE KEY-----', '-----BEGIN PRIVATE KEY-----', '-----BEGIN EC PRIVATE KEY-----'])}"
        f" WHEN 8 THEN concat({pick('k / 11', other)}, {pick('k / 91', [' ', ': ', ' = ', '-'])}, if(k % 2 = 0, s, m)) WHEN 9 THEN concat({pick('k / 11', numbers)}, ' ', {digits}, '0123') WHEN 10 THEN concat({pick('k / 11', numbers)}, ' ', substr({digits}, 1, 12), '4567')"
        f" WHEN 11 THEN concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-4', substr(m, 13, 3), '-a', substr(m, 17, 3), '-', substr(m, 21, 12)) WHEN 12 THEN concat('/home/user/project/', {pick('k', DICTIONARY)}, '/', {pick('k / 17', DICTIONARY)}, k % 100, '/index')"
        f" WHEN 13 THEN concat('https://www.example.com/', {pick('k', DICTIONARY)}, '/', {pick('k / 17', DICTIONARY)}, '-', {pick('k / 31', DICTIONARY)}, '-', k % 1000) WHEN 14 THEN concat({key}, {join}, {pick('k / 3', ['your', 'example', 'placeholder', 'dummy', 'sample'])}, '-', {key}, '-', {pick('k', DICTIONARY)}, '-1234', {close % join})"
        f" WHEN 15 THEN concat({pick('k', DICTIONARY)}, '_', {pick('k / 17', DICTIONARY)}, '_', {pick('k / 31', DICTIONARY)}, '_2024', k % 10)"
        # the same again for what has no digit, is short, or is an address, a block or a reference; secrets where id % 16 < 8
        f" WHEN 16 THEN concat({key}, {join}, {strong}, {close % join}) WHEN 17 THEN concat({key}, {join}, {weak}, {close % join}) WHEN 18 THEN concat({key}, {join}, substr({letters}, 1, 16 + k % 24), {close % join})"
        f" WHEN 19 THEN concat({scheme}, '://:', {pick('k / 3', ['a', 'b', 'c'])}, {weak}, '@', {host}, '/x') WHEN 20 THEN concat({scheme}, '://', {pick('k / 3', ['app', 'user', 'service-account-of-the-long-name', 'db'])}, ':', substr(b, 2, 2), {pick('k / 5', ['/', ':', '/x:', '', '@'])}, {strong}, '@', {host}, '/x')"
        f" WHEN 21 THEN if(k % 2 = 0, concat({pick('k / 5', ['', 'key ', 'id '])}, 'AKIA', upper(substr({letters}, 1, 16))), concat({pick('k / 5', ['', 'jwt ', 'use '])}, 'eyJ', substr({plain}, 1, 8 + k % 20), '.eyJ', substr({plain}, 5, 8 + k % 20), '.', substr({plain}, 9, 10 + k % 20)))"
        f" WHEN 22 THEN concat('-----BEGIN ', {kind}, 'PRIVATE KEY-----', {pick('k / 5', [chr(10), ' '])}, b, {pick('k / 5', [chr(10), ' '])}, substr({plain}, 1, 8 + k % 30), {pick('k / 5', [chr(10), ' '])}, '-----END ', {kind}, 'PRIVATE KEY-----')"
        f" WHEN 23 THEN if(k % 2 = 0, concat('Authorization: Bearer ', substr({plain}, 1, 12 + k % 28)), concat('\"', {key}, '\": \"', {pick('k / 3', ['', 'A', 'z9'])}, {strong}, '\"'))"
        f" WHEN 24 THEN concat({key}, {join}, {pick('k / 3', REFERENCES)}, {close % join}) WHEN 25 THEN if(k % 4 = 0, concat('bearer of ', {pick('k / 19', fill)}), concat({key}, {pick('k / 7', [': ', ' = ', ':' + chr(10)])}, {pick('k / 17', fill)}))"
        f" WHEN 26 THEN concat('http://', {pick('k', DICTIONARY)}, ':', 80 + k % 9000, '/', {pick('k / 17', DICTIONARY)}, '/', {pick('k / 31', DICTIONARY)}, '@', {host}) WHEN 27 THEN concat({pick('k', ['mailto:', 'Email:', 'e-mail:', 'contact:', 'von:', 'To:', 'mail:'])}, {pick('k / 7', DICTIONARY)}, {pick('k / 31', ['', '.', '_', '-'])}, {pick('k / 17', DICTIONARY)}, {pick('k / 5', ['', '7', '26'])}, '@', {host})"
        f" WHEN 28 THEN if(k % 4 = 0, concat({pick('k', DICTIONARY)}, {title % pick('k / 17', DICTIONARY)}, {title % pick('k / 31', DICTIONARY)}, {title % pick('k / 97', DICTIONARY)}), {word}) WHEN 29 THEN if(k % 2 = 0, concat('/', {pick('k', DICTIONARY)}, '/', {pick('k / 17', DICTIONARY)}, '/', {pick('k / 31', DICTIONARY)}, '-', {pick('k / 97', DICTIONARY)}), repeat({pick('k / 3', ['x', '-', '_', '/', 'A', '0', 'ab', '+'])}, 16 + k % 200))"
        f" WHEN 30 THEN concat('-----BEGIN ', {pick('k', ['CERTIFICATE', 'PUBLIC KEY', 'RSA PUBLIC KEY'])}, '-----', {pick('k / 5', [chr(10), ' '])}, b, b) ELSE concat({pick('k', ['max_tokens', 'token_count', 'tokens', 'password_length', 'auth_level', 'token', 'secret_version', 'author'])}, {join}, if(k % 5 = 0, {pick('k / 3', ['Smith', 'Anna', 'Miller', 'open', 'Jean'])}, string(k % 5000)), {close % join}) END"
    )
    path = f"if(id % 16 = 14, concat('tests/', {pick('k', DICTIONARY)}, '.py'), if(k % 3 = 0, concat('src/', {pick('k', DICTIONARY)}, '.py'), ''))"
    # every fourth path stands in the text, as in logs, and not beside it
    told = f"if(k % 4 = 0 AND length({path}) > 0, concat({path}, ': '), '')"
    return base.selectExpr("id", f"concat({pick('k / 13', fill)}, ' ', {told}, {value}, ' ', {pick('k / 19', fill)}) AS text", f"if(k % 4 = 0, '', {path}) AS path", "double(id % 16 < 8) AS label")


def _condition(node: object, names: tuple[str, ...]) -> str:
    """SQL of a tree: the share of secrets at the leaf that the inputs ``f`` lead to."""
    if node.subtreeDepth() == 0:
        counts = list(node.impurityStats().stats())
        return f"{counts[1] / max(sum(counts), 1e-12):.6f}D"
    split = node.split()
    return f"if(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, {_condition(node.leftChild(), names)}, {_condition(node.rightChild(), names)})"


def grow_forest(findings: DataFrame) -> str:
    """SQL over a struct ``f`` of inputs: the forest's probability that a candidate is a secret.

    ``findings`` has text, path and label (1: a secret); each candidate in a
    text is an example. A labelled table is small beside a corpus: it is read as one part.
    """
    told = cut(findings.select("text", "path", F.col("label").cast("double").alias("label")).where("text is not null and label is not null"), "findings")
    found = cut(with_candidates(told).select("label", F.explode("candidates").alias("c")), "candidates")
    flat = found.select("label", "c.inputs.*").coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)
    trees = [_condition(t._java_obj.rootNode(), FEATURES) for t in forest.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}"


@lru_cache(maxsize=1)
def _default_forest(application: str) -> str:
    return grow_forest(synthetic_findings(SparkSession.active()))


def default_forest(spark: SparkSession) -> str:
    """The forest of the synthetic findings; grown once in an application."""
    return _default_forest(spark.sparkContext.applicationId)


def scan(docs: DataFrame, forest: str | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_candidates, n_secrets, findings, redacted.

    ``findings`` are structs (start, stop, score, is_secret) in the text's order, by
    characters from 0; ``redacted`` is the text with each secret as MASK, null
    for a null text. Texts of any length are read whole. ``path_col`` may name a file or
    a source; a path that stands right before a candidate counts as well. Without
    either no path speaks for or against it.
    Write the result before filtering it by its findings: Spark would work them out
    again for the filter.
    """
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    rows = found_in(rows, forest, threshold)
    return rows.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.expr("bigint(size(filter(findings, x -> x.is_secret)))").alias("n_secrets"), "findings", redacted().alias("redacted"))


def found_in(rows: DataFrame, forest: str, threshold: float) -> DataFrame:
    """Adds ``findings`` to rows with the columns text and path."""
    rows = with_candidates(rows).withColumn("_scored", F.expr(f"transform(candidates, c -> named_struct('start', c.start, 'stop', c.stop, 'score', transform(array(c.inputs), f -> {forest})[0]))"))
    return rows.withColumn("findings", F.expr(f"transform(_scored, x -> named_struct('start', x.start, 'stop', x.stop, 'score', x.score, 'is_secret', x.score >= {threshold}D))")).drop("_scored", "candidates")


def redacted() -> Column:
    """The column text with the secrets among the column findings masked, from the columns that :func:`found_in` adds.

    Put together from the parts that were cut apart; a text that itself holds
    the marks, whose parts differ from it, by offsets.
    """
    first, last = MARKS
    woven = f"array_join(transform(_parts, (p, i) -> if(i = 0, p, concat(if(findings[greatest(i - 1, 0)].is_secret, '{MASK}', substring_index(p, '{last}', 1)), substring_index(p, '{last}', -1)))), '')"
    secrets = "filter(findings, x -> x.is_secret)"
    pieces = (
        f"transform(array({secrets}), s -> concat(array_join(transform(s, (x, i) -> concat(substring(text, if(i = 0, 0, s[greatest(i - 1, 0)].stop) + 1, x.start - if(i = 0, 0, s[greatest(i - 1, 0)].stop)), '{MASK}')), ''),"
        " substring(text, s[size(s) - 1].stop + 1, length(text))))[0]"
    )
    marked = F.col("text").contains(first) | F.col("text").contains(last)
    return F.when(F.expr("exists(findings, x -> x.is_secret)"), F.when(marked, F.expr(pieces)).otherwise(F.expr(woven))).otherwise(F.col("text"))


def redact(docs: DataFrame, forest: str | None = None, text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the secrets of the text masked; all columns and rows stay."""
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    inner = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), path.alias("path"))
    masked = found_in(inner, forest, threshold).select("row", redacted().alias("masked"))
    return masked.select(*(F.col("masked").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
