"""DataFrame-to-DataFrame operators; each works on a whole batch of questions or documents."""
