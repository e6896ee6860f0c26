"""Pattern sets, code tables and constants of the clinical study.

They are data, not logic. Every operator takes them as parameters, so another
study passes its own.
"""

# LIKE patterns of the index condition.
INDEX_PATTERNS = ("%高血压%", "%HBP%")

# LIKE patterns of the excluded sub-conditions.
EXCLUDED_PATTERNS = ("%难治%高血压%", "%妊娠%高血压%")

# LIKE patterns of the outcome conditions.
OUTCOME_PATTERNS = (
    "%脑卒中%",
    "%脑梗%",
    "%TIA%",
    "%短暂性缺血性发作%",
    "%房%颤%",
    "%心%衰%",
    "%心%梗%",
    "%肾%衰%",
    "%冠%心%病%",
    "%肺源性心脏病%",
    "%CKD%",
    "%cad%",
    "%高血压性心脏病%",
    "%高血压心脏病%",
    "%动脉粥样硬化%",
)

# Fixed value: drug codes of the exposure class start with this letter.
EXPOSURE_CODE_PREFIX = "C"

# Fixed value: fee categories that hold medication.
MEDICATION_CATEGORY_PATTERN = "%药费%"

# Sex codes.
SEX_CODES = {"男": 0, "女": 1}

# A drug code is excluded if its first characters contain the marker.
EXCLUDED_CODE_MARKER = "1"
CODE_HEAD_WIDTH = 3

# Fixed value: a leading remark in ASCII or full-width brackets.
BRACKET_PREFIX = r"^[(（].*?[)）]+"

# Full-width brackets and their ASCII forms; question marks to remove.
WIDE_BRACKETS, PLAIN_BRACKETS = "（）", "()"
QUESTION_MARKS = "?？"

# Fixed value: number of histogram bins when none is given.
HISTOGRAM_BINS = 10

# Fixed value: word appended when a walk through the dictionary stops one
# character short of a tablet name.
TABLET_SUFFIX = "片"

# Fixed value: marker for a name that is not text.
MISSING_NAME = "空值"

# Fixed value: mean length of a Gregorian year in days.
DAYS_PER_YEAR = 365.2425

# The characters Unicode counts as white space when text is
# stripped on both sides (control separators included).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
