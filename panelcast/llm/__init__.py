"""Training-data operators: quality rules, byte-pair encoding, nearest
neighbours, sharding, language ID, chat formatting, token files, Jaccard
components, WARC archives, benchmark decontamination, source divergence, ranked
search and secret scans.

``queries.py`` holds the registered ``opN_<name>`` queries.  Nothing outside
this subpackage (and ``corpus_pipeline.py``) imports it.
"""
