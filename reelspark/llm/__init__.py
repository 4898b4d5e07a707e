"""Operations for preparing language-model training data from the project's records. Nothing else imports this."""
