"""Training-data operators. Nothing outside this package imports it.

Shared rules of the ten operators, unless an operator's docstring says otherwise:

* an operator reads only the id and the text (or vector) column it is told to read, so other
  columns of any name, also names that the result uses, never get in its way;
* a null text gives a row with nulls (per-row operators) or takes no part (joins); an empty text is a
  text of length 0; a null id is carried as it is;
* rows that repeat an id are separate rows in per-row operators;
* an empty table gives an empty result with the same schema.
"""
