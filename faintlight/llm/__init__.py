"""Operators for preparing training corpora: ten building blocks over documents, embeddings and conversations."""
