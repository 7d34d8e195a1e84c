"""Fixed values that results depend on.  Kept together, in natural order."""

# --- fixed values -----------------------------------------------------------
# English stop words of the NLTK corpus (179 entries), the default stop list
# of the corpus pipeline (stop-list kind "nltk-english").
NLTK_ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Text cleaning defaults, applied in this order.  Patterns removed outright:
CLEAN_REMOVE = [r"\(", r"\)", r",(?=[^\d\s])"]
# Patterns replaced by one space:
CLEAN_TO_SPACE = ["/", ":", "  ", "-", "–", "−"]
# Then "+" becomes "plus", "*" is removed and the text is lower-cased.

# Largest phrase length kept by the RAKE candidate step (words per phrase).
RAKE_MAX_WORDS = 5

# Sort keys of paged retrieval: two-letter code -> meaning.  Relevance and
# times cited sort descending only.
RETRIEVE_SORT_FIELDS = {
    "AU": "author", "CF": "conference title", "CG": "page", "CW": "source",
    "CV": "volume", "LC": "local times cited", "LD": "load date", "PG": "page",
    "PY": "publication year", "RS": "relevance", "SO": "source",
    "TC": "times cited", "VL": "volume",
}
RETRIEVE_DESC_ONLY = ("RS", "TC")
# Load-date windows of the symbolic time span, in days.
SYMBOLIC_TIME_SPANS = {"1week": 7, "2week": 14, "4week": 28}
# --- end fixed values -------------------------------------------------------
