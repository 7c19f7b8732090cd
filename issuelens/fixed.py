"""Fixed values.

Everything in this module is a literal that results depend on: keyword lists,
stop lists, the punctuation set and the default lexicon. They are stated here
once, plainly, in their natural order, and every operator and every oracle SQL
string reads them from here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: must equal the published configuration.
# ---------------------------------------------------------------------------

# ASCII punctuation, in code-point order (32 characters).
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Keyword lists used by the labeller, one per extraction method, in list order
# (list order decides ties).
KEYWORDS = {
    "seed_expansion": [
        "move", "refactor", "remove", "dependency", "couple", "update", "improve",
        "relocate", "transfer", "migrate", "problem", "increase", "extend",
        "depend", "change",
    ],
    "mmr": [
        "move", "could", "test", "version", "package", "dependency", "upgrade",
        "class", "use", "also", "need", "like", "api", "build", "library",
    ],
    "tfidf": [
        "use", "test", "package", "upgrade", "file", "version", "need", "like",
        "class", "dependency", "remove", "place", "old", "add", "new",
    ],
}
METHODS = list(KEYWORDS)

# Seed keywords of the iterative expansion.
SEED_KEYWORDS = ["move", "refactor", "remove", "dependency", "couple", "update"]

# Words that are never stopwords in the labelling chain.
STOPWORD_WHITELIST = ["move"]

# Custom stop list of the seed-expansion chain.
SEED_STOPWORDS = [
    "netty", "function", "process", "data", "service", "jetty", "camel",
    "hbase", "thrift", "jena", "httpaction", "bookkeeper", "shards", "junit",
    "linux", "ubuntu", "hadoop", "fuseki", "nifi", "flink", "yarn", "abdera",
    "jdk", "aries", "airflow", "rat", "apache", "mapred", "eol", "python",
    "jboss",
]

# Additional stop list of the MMR (bigram) chain; also bans phrases (FLT-5).
MMR_STOPWORDS = [
    "hadoop", "camel", "thrift", "yarn", "ruby", "apache", "rat", "impala",
    "chrome", "eric", "namespace", "impl", "xml", "csharp", "go", "perl",
    "apache", "org", "jboss", "aries", "maven", "pom", "java", "grpc", "eol",
    "elk", "doe", "wa", "ha", "https", "one", "set", "activemq", "mvc", "http",
]

# Excluded words of the MMR chain (a set holding only the empty string).
MMR_EXCLUDED = [""]

# Project names added to the stop list of the TF-IDF chain.
TFIDF_PROJECT_STOPWORDS = [
    "camel", "thrift", "hbase", "hadoop", "apache", "ws0432", "rat", "itd", "ct",
    "airflow4535", "jobspy", "airflow", "junit", "smx", "debian", "conf", "perl",
    "python", "initnewcluster", "localtaskexecutor", "ubuntu", "sitepackages",
    "distutils", "josh", "jdk", "jasypt", "libs", "jbang",
    "mainhelpersetpropertiesontargetmainhelperjava", "hadooptools",
    "cameljgropus", "camelsql", "concurrentmodificationexception",
    "shellprofiles", "bytessource", "assertj",
    "httpsgithubcombelabanjgroupsdiscussionsdiscussioncomment", "oahhclient",
    "bean", "mqtt",
    "avrohttpsgithubcomapacheavroblobreleaselangjavaavrosrcmainjavaorgapacheavroschemajavall",
    "camelatom", "yarn", "google", "abdera", "cfx", "camelcxf", "yang", "id",
    "camelgrpc", "net", "namevalidator",
]

# Part-of-speech sets kept by the chains.
POS_LABELLING = ["NOUN", "VERB", "ADJ", "ADV", "AUX", "PART"]
POS_SEED = ["NOUN", "VERB", "ADJ"]

# Configured constants.
THRESHOLD = 0.9
NGRAM_N = 1
TOP_N_TERMS = 25
TOP_N_SEED = 10
DIVERSITY = 0.5
EXPANSION_ROUNDS = 5
NEW_SEEDS = 3
MAX_FEATURES = 1000
TOKEN_MIN_EXCL = 2
TOKEN_MAX_EXCL = 512
TEST_SHARE = 0.2
SEED = 42
QUERY_SIZE = 100
NUM_QUERIES = 25
FUZZ_CUTOFF = 85
LABEL_POS = "ATD-Related"
LABEL_NEG = "Non-ATD"
CLASS_NAMES = ["Non-ATD", "ATD"]

# ---------------------------------------------------------------------------
# FIXED VALUES: Spark's default English stop list
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"), 181
# words, in its own order). A test asserts equality with the running Spark.
# ---------------------------------------------------------------------------
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he "
    "him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't "
    "hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't "
    "can't couldn't cannot could here's how's let's ought that's there's what's "
    "when's where's who's why's would"
).split()

# ---------------------------------------------------------------------------
# Default lexicon (token -> part of speech, lemma). This is the engine's own
# deterministic stand-in for a tagger and lemmatiser: function words that are
# not in the stop list, and inflections of the keyword vocabulary. Tokens not
# listed are tagged by rule (all digits -> NUM, otherwise NOUN) and are their
# own lemma. A caller can pass a larger lexicon table instead.
# ---------------------------------------------------------------------------
_FUNCTION_WORDS = {
    "DET": "every another many several either neither much whatever",
    "ADP": "within without upon via per among across toward towards onto along "
           "around behind beside beyond despite except inside outside since "
           "throughout unlike versus amongst",
    "PRON": "everything something anything nothing anyone someone everyone "
            "nobody somebody everybody yourself",
    "CCONJ": "yet plus",
    "SCONJ": "although though unless whether whereas",
    "INTJ": "yes ok okay please hello hi thanks",
    "NUM": "zero one two three four five six seven eight nine ten hundred thousand",
    "AUX": "may might must shall",
    "PART": "n't 's",
}

_INFLECTIONS = {
    # lemma: (pos, forms)
    "move": ("VERB", "moves moved moving"),
    "refactor": ("VERB", "refactors refactored refactoring"),
    "remove": ("VERB", "removes removed removing"),
    "couple": ("VERB", "couples coupled"),
    "update": ("VERB", "updates updated updating"),
    "improve": ("VERB", "improves improved improving"),
    "relocate": ("VERB", "relocates relocated relocating"),
    "transfer": ("VERB", "transfers transferred transferring"),
    "migrate": ("VERB", "migrates migrated migrating"),
    "increase": ("VERB", "increases increased increasing"),
    "extend": ("VERB", "extends extended extending"),
    "depend": ("VERB", "depends depended depending"),
    "change": ("VERB", "changes changed changing"),
    "use": ("VERB", "uses used using"),
    "need": ("VERB", "needs needed needing"),
    "upgrade": ("VERB", "upgrades upgraded upgrading"),
    "build": ("VERB", "builds built building"),
    "test": ("VERB", "tests tested testing"),
    "add": ("VERB", "adds added adding"),
    "fix": ("VERB", "fixes fixed fixing"),
    "make": ("VERB", "makes made making"),
    "run": ("VERB", "runs ran running"),
    "get": ("VERB", "gets got getting"),
    "create": ("VERB", "creates created creating"),
    "dependency": ("NOUN", "dependencies"),
    "problem": ("NOUN", "problems"),
    "package": ("NOUN", "packages"),
    "version": ("NOUN", "versions"),
    "class": ("NOUN", "classes"),
    "library": ("NOUN", "libraries"),
    "file": ("NOUN", "files"),
    "api": ("NOUN", "apis"),
    "issue": ("NOUN", "issues"),
    "module": ("NOUN", "modules"),
    "method": ("NOUN", "methods"),
    "place": ("NOUN", "places"),
    "old": ("ADJ", "older oldest"),
    "new": ("ADJ", "newer newest"),
    "like": ("ADP", ""),
    "also": ("ADV", ""),
}


def default_lexicon() -> list[tuple[str, str, str]]:
    """The default lexicon as ``(token, pos, lemma)`` rows (about 160 rows)."""
    rows: list[tuple[str, str, str]] = []
    for pos, words in _FUNCTION_WORDS.items():
        rows.extend((w, pos, w) for w in words.split())
    for lemma, (pos, forms) in _INFLECTIONS.items():
        rows.append((lemma, pos, lemma))
        rows.extend((f, pos, lemma) for f in forms.split())
    seen: dict[str, tuple[str, str, str]] = {}
    for r in rows:
        seen.setdefault(r[0], r)
    return list(seen.values())


# Penn-style tag per universal part of speech (for TOK-10 on lexicon output).
PENN_OF_POS = {
    "NOUN": "NN", "VERB": "VB", "ADJ": "JJ", "ADV": "RB", "AUX": "MD",
    "PART": "RP", "DET": "DT", "ADP": "IN", "PRON": "PRP", "CCONJ": "CC",
    "SCONJ": "IN", "INTJ": "UH", "NUM": "CD",
}
