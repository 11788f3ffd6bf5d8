"""Word lists and marks that results depend on."""

# Fixed values. The mark that replaces a key chunk.
BLANK = "__________"
NO_DISTRACTOR = "(No distractor available)"
ANSWER_MASK = "[answer]"
FALLBACK_DISTRACTORS = ["option1", "option2", "option3"]
FALLBACK_ANCHOR = "According to the passage"
LETTERS = ["A", "B", "C", "D"]

# Fixed values. Words too general to be asked for.
GENERIC_WORDS = [
    "something", "anything", "nothing", "everything", "things",
    "someone", "anyone", "it", "this", "that",
    "they", "he", "she", "one", "ones",
    "way", "part", "kind", "type", "lot",
]

# Fixed values. Spark's English stop words, without the entries that hold an
# apostrophe: the token rules never produce those.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "cannot", "could", "ought", "would",
]
