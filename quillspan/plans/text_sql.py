"""Parts of SQL that several queries share."""

TOKENS = "list_filter(list_transform(regexp_extract_all(replace(replace({0}, '—', ' '), '–', ' '), '[A-Za-z0-9À-ɏ''’‘-]+'), lambda t: trim(t, '''-’‘')), lambda t: t <> '')"
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\\.?"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_DATE = " or ".join(
    f"regexp_matches(t, '{p}')"
    for p in [
        r"(?i)^\W*(?:mon|tues|tue|wednes|wed|thurs|thu|fri|satur|sat|sun)(?:day)?\b",
        rf"(?i)\b{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?\b",
        rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}\b",
        rf"(?i)\b{_MONTH}\s+(?:19|20)\d{{2}}\b",
        r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b",
        r"\b(?:19|20)\d{2}[/.\-]\d{1,2}[/.\-]\d{1,2}\b",
        r"^\W*(?:19|20)\d{2}\W*$",
    ]
)
#: Whether ``t``, a trimmed line, reads like a date or a time of day.
DATES = f"({_DATE} or (regexp_matches(t, '(?i)\\b\\d{{1,2}}[:.]\\d{{2}}\\s*(?:am|pm|h)?\\b') and len(string_split_regex(t, '\\s+')) <= 4))"
