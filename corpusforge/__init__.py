"""CorpusForge: a Spark-native engine for curating and analysing text corpora.

Every operator is a function from DataFrame(s) to DataFrame; queries over the
project's tables live in :mod:`corpusforge.plans`.
"""
