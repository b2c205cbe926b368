"""Operations of a training-data pipeline: near duplicates, chat formatting, packing, decontamination and the like.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
