"""Operations for preparing training data at corpus scale, one module per operator."""
