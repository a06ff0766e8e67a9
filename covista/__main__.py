from covista.cli import main

main()
