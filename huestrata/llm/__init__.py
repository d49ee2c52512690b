"""Training-data operators over documents, vectors and web captures.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
