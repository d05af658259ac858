"""Operations of a training-data pipeline over documents and pages; nothing else in the library imports them."""
