"""moderato: comment-moderation analytics as Spark DataFrame operators.

Every public operator takes a DataFrame (plus Columns / parameters) and
returns a DataFrame or Column, so Catalyst sees one declarative plan.
"""

from moderato.schema import LABELS

__all__ = ["LABELS"]
