"""Fixed values that results depend on, and primary keys of the catalogue's tables."""

# fixed values: stopwords of the first keyword pass
KEYWORD_STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "in", "on", "at", "for", "to", "with", "by", "from", "about", "as", "is", "are", "was", "were",
    "be", "been", "that", "this", "it", "its", "which", "who", "whom",
)

# fixed values: shelf tags that say nothing about a book
DENIED_TAGS = (
    "to-read", "tbr", "currently-reading", "read", "read-in-2024", "favorites", "favourites", "favorite", "favourite", "wishlist", "owned", "own",
    "school", "physical-tbr", "digital-tbr", "read-for-school", "school-books", "for-school", "my-books", "library", "all-time-favorites", "re-read",
    "reread", "to-buy", "5-stars", "favorite-books", "bookshelf", "home-library", "favs", "books-i-have", "want-to-buy", "to-reread", "must-read",
    "must-have", "i-own", "read-again", "dnf", "did-not-finish", "want-to-read", "books-i-own", "books-i-own-but-havent-read", "owned-books",
    "my-library", "ebooks", "kindle", "kindle-books", "audible", "audio", "audio-books", "audiobooks", "library-books", "book-club", "bookclub", "shelved",
)

# fixed values: parts of shelf tags that deny them
DENIED_TAG_PARTS = (
    "to-read", "currently_reading", "currently-reading", "favorite", "favourite", "wishlist", "owned", "own", "library", "bookclub", "book-club", "club",
    "school", "tbr", "dnf", "kindle", "audiobook", "audio-book", "audible", "giveaway", "netgalley", "ebook", "e-book", "digital", "physical", "signed",
    "autographed", "filmed", "movie", "adaptation",
)

# fixed values: patterns of shelf tags that deny them
DENIED_TAG_PATTERNS = (
    r"\bread[-_ ]?(?:in|during)[-_ ]?\d{4}\b", r"\bred[-_ ]?\d{4}\b", r"\b\d{4}-?reads\b", r"\b\d{4}-?books\b", r"\bowned[-_ ]?\d{1,2}\b",
    r"\bbooks[-_ ]?i[-_ ]?(?:own|have)\b",
)

# fixed values: stopwords of keyword extraction; single digits belong to them
EXTRACTION_STOPWORDS = (
    "a", "about", "after", "an", "and", "are", "as", "at", "be", "been", "before", "between", "by", "com", "con", "che", "de", "di", "el", "een", "en",
    "er", "for", "from", "he", "her", "hers", "him", "his", "how", "il", "in", "into", "is", "it", "its", "ji", "kai", "la", "las", "por", "del", "su",
    "los", "lo", "mn", "fy", "lm", "wl", "et", "des", "une", "dans", "est", "du", "da", "ele", "ela", "dele", "dela", "tu", "você", "nostro", "nosso",
    "le", "les", "mas", "na", "o", "och", "of", "og", "on", "or", "som", "our", "ours", "over", "po", "que", "se", "she", "shi", "that", "the", "this",
    "through", "to", "ton", "under", "un", "una", "us", "was", "we", "were", "which", "who", "whom", "without", "with", "yours", "your", "you", "zi", "za",
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "9",
)

# fixed values: texts that mean "missing"
MISSING = ("", "[]", "{}", "()", "nan", "none", "null")

# fixed values: primary keys of the tables that increments are merged into
PRIMARY_KEYS = {
    "work_final": ("work_id",), "book_final": ("book_id",), "series_final": ("series_id",), "people_final": ("author_id",),
    "publisher_final": ("publisher_id",), "year_final": ("year",), "country_final": ("country_code",), "languages_final": ("language_code",),
    "tags_final": ("tag_id",), "extracted_keywords": ("entity_type", "entity_id", "keyword"),
    "citation_mentions": ("source_type", "source_id", "target_type", "target_id"),
}

# fixed values: thresholds that a run is held against
SUCCESS = {"embedding_coverage": 0.90, "graph_coverage": 0.30, "giant_ratio": 0.10, "modularity": 0.30, "tag_purity": 0.20, "keyword_purity": 0.25}
RESOLUTIONS = (0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0)
