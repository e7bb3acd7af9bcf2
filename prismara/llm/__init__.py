"""Operations of a training-data pipeline on documents, vectors and web pages."""
