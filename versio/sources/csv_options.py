"""CSV options shared by the readers and writers."""

# CSV options that keep texts as they are. Outer spaces stay,
# embedded quotes and newlines are quoted the RFC 4180 way, and null is \\N; a
# text that starts with a backslash is written with one more, so none reads as null.
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "nullValue": "\\N", "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
