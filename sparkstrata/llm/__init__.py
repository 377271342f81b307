"""Operations a training-data pipeline needs, each written for tables far larger than memory."""
