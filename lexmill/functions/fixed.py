"""Marks, lookup tables, word lists and patterns of the data format."""

# Marks that stand for layout and white space in token streams.
NEW_LINE = "NEW_LINE"
INDENT = "INDENT"
DEDENT = "DEDENT"
ENDCOM = "ENDCOM"
SPACE_MARK = "▁"
SPACE_TOKEN = "SPACETOKEN"
STR_NEWLINE = "STRNEWLINE"
TAB_SYMBOL = "TABSYMBOL"

# Marks for braces while lines are laid out, and what is replaced before and after that, in this order.
OPEN_BRACE, CLOSE_BRACE = "OB_", "CB_"
BRACES_TO_MARKS = (
    ("\n", "NEW_LINE"),
    ('} "', 'CB_ "'),
    ('" {', '" OB_'),
    ("} ;", "CB_COLON"),
    ("} ,", "CB_COMA"),
    ("}", "CB_"),
    ("{", "OB_"),
)
MARKS_TO_BRACES = (
    ("CB_COLON", "};"),
    ("CB_COMA", "},"),
    ("CB_", "}"),
    ("OB_", "{"),
    ("> > >", ">>>"),
    ("<< <", "<<<"),
    ("> >", ">>"),
    ("< <", "<<"),
)
PYTHON_DOTS = ((". ", "."), (" .", "."), ("import.", "import ."), ("from.", "from ."))

# Character sequences kept as one token inside literals and comments.
# The order counts: every entry is applied to the result of the entries before it.
C_SPECIALS = (
    ("STOKEN00", "//"),
    ("STOKEN01", "/*"),
    ("STOKEN02", "*/"),
    ("STOKEN03", "/**"),
    ("STOKEN04", "**/"),
    ("STOKEN05", '"""'),
    ("STOKEN06", "\\n"),
    ("STOKEN07", "\\r"),
    ("STOKEN08", ";"),
    ("STOKEN09", "{"),
    ("STOKEN10", "}"),
    ("STOKEN11", "\\'"),
    ("STOKEN12", '\\"'),
    ("STOKEN13", "\\\\"),
)
PYTHON_SPECIALS = (
    ("STOKEN00", "#"),
    ("STOKEN1", "\\n"),
    ("STOKEN2", '"""'),
    ("STOKEN3", "'''"),
)
SPECIALS = {"cpp": C_SPECIALS, "java": C_SPECIALS, "python": PYTHON_SPECIALS}

# Tags of comments and of literals, by language.
COMMENT = "comment"
LITERAL_TAGS = {
    "cpp": ("comment", "string_literal", "char_literal"),
    "java": ("comment", "string_literal", "character_literal"),
    "python": ("comment", "docstring", "string"),
}
NAME_TAGS = ("identifier", "field_identifier")

# Reserved words of the two C-family languages (public language standards).
CPP_KEYWORDS = tuple(
    """alignas alignof asm auto bool break case catch char class co_await co_return co_yield
    concept const consteval constexpr constinit const_cast continue decltype default delete do
    double dynamic_cast else enum explicit export extern false final float for friend goto if
    inline int long mutable namespace new noexcept nullptr operator override private protected
    public register reinterpret_cast requires return short signed sizeof static static_assert
    static_cast struct switch template this thread_local throw true try typedef typeid typename
    union unsigned using virtual void volatile wchar_t while""".split()
)
JAVA_KEYWORDS = tuple(
    """abstract assert boolean break byte case catch char class const continue default do double
    else enum extends false final finally float for goto if implements import instanceof int
    interface long native new null package private protected public return short static strictfp
    super switch synchronized this throw throws transient true try void volatile while""".split()
)

# Text left behind by a preprocessor in a token stream, removed in this order.
PREPROCESSOR_PATTERNS = (
    r'# include ".*?"',
    r"# include <.*?>",
    r"# ifndef [^ ]*",
    r"# ifdef [^ ]*",
    r"# define [^ ]* \( .*? \) \( .* \)",
    r"# define [^ ]* \( .*? \) \{ .* \}",
    r'# define [^ ]* (\( )?".*?"( \))?',
    r"# define [^ ]* (\( )?[0-9]*\.?[0-9]*( [+-/*] ?[0-9]*\.?[0-9]*)?( \))?",
    r"# define [^ ]",
    r"# if defined \( .*? \)",
    r"# if [^ ]*",
)
PREPROCESSOR_WORDS = ("# else", "# endif")
HEREDOC_PATTERN = r"< DOCUMENT.*?> "
ANNOTATION_PATTERN = r"^@ (Override|Deprecated|SuppressWarnings) (\( .*? \) )"

# Marks of Python 2 in a tokenised function.
PYTHON2_PATTERNS = (
    r"print [^(]",
    r"raise [\p{L}\p{N}_]+ ,",
    r"except [\p{L}\p{N}_]+ ,",
    r"[^ ]+ = \p{Nd}+ L",
)
PYTHON2_WORDS = (
    ". iterkeys ( )",
    ". itervalues ( )",
    ". iteritems ( )",
    "xrange (",
    "imap (",
)

# String prefixes that are set apart from the quote in Python token streams.
PYTHON_STRING_PREFIXES = ("r", "u", "f", "rf", "fr", "b", "rb", "br")

# Block layout of the delimited text corpus.
BLOCK_DELIMITER = "-" * 25
SYSEVR_FILES = ("API_function_call", "Arithmetic_expression", "Array_usage", "Pointer_usage")

# Split names with their shares.
TRAIN, VALIDATION, TEST = "train", "validation", "test"
