"""corpusprep: Spark-native preparation and evaluation of speech/text training corpora.

Every operator is either ``Column -> Column`` (``corpusprep.functions``) or
``DataFrame -> DataFrame`` (``corpusprep.operators``), so it composes with
``DataFrame.transform`` and stays inside Catalyst.
"""

__version__ = "0.1.0"
