"""Tessera: analytics over code and text corpora, written for Spark DataFrames.

Sub-packages
------------
sources     readers and writers (tables, file trees, JSON graphs, manifests, logs)
functions   Column-level expressions, each a pure ``Column -> Column`` function
operators   DataFrame operators (``DataFrame -> DataFrame``)
plans       named queries over a data directory, with the SQL they are checked against
streaming   incremental and stateful forms
llm         operators for preparing training data (optional; nothing else imports it)
"""

__version__ = "0.1.0"
